"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

Each text's set of k-word shingles is hashed once; the hash's top bits choose a bin, the least hash of a bin is its
signature value, and an empty bin takes the value of the first non-empty bin in its own pseudo-random order. Equal sets
form a class at once (pre-aggregated, so thousands of copies are one row afterwards). Classes that share a band of
signature values share a bucket.

A bucket's candidates are a star: one member, drawn by a hash, against all others, so a bucket of m members has m - 1
pairs whatever they hold. Every bucket draws a centre of its own, and buckets whose members still lie in several
components draw again, `rounds` times in all; members of the centre's component are not compared again. Stars find most
links. A pair is set aside without its sets only where that is certain: sets whose bins differ in more places than their
symmetric difference may have elements. All others are confirmed on their full sets.

What stars leave open is closed exactly: components that still share a bucket form a family, and all pairs of a family
whose components differ are compared on their full sets, so no link between texts that share a bucket is lost. Shared
elements are counted along the shorter of two lists, the members that have a shingle or those that lack it: near copies
of one text differ in little, and only that is walked. A family is dealt in pairs of blocks, and a task gives at most
one link for each two components it joins.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and are kept. A text with fewer
than k words is one shingle. Rows are judged by their text: equal ids with different texts lie where their texts
belong. The component's id is its smallest doc_id that is not null (null where it has none; such rows are all kept). Of
repeated rows each has its row in the result. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, arrow_bytes, csr_gather, cut, documents, drop_cuts, lower_ascii, mix, range_hashes, slices, word_ranges
from .components import connected

BINS, ROWS = 128, 4
#: Stars that a bucket may have.
ROUNDS = 4
#: Shingles and members of a block of a family.
BLOCK_SHINGLES, BLOCK_MEMBERS = 2_000_000, 15_000
_MIXERS = mix(np.arange(11, 43, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    low = lower_ascii(buf)
    start, end, row = word_ranges(low, offsets)
    words = range_hashes(low, start, end)
    n = len(words)
    rows = len(offsets) - 1
    edge = np.searchsorted(row, np.arange(rows + 1))
    if n >= k:
        sh = words[: n - k + 1] * _MIXERS[0]
        for i in range(1, k):
            sh = mix(sh) + words[i : n - k + 1 + i] * _MIXERS[i]
        sh = mix(sh)
    out = []
    for r in range(rows):
        a, b = edge[r], edge[r + 1]
        if b - a >= k:
            out.append(np.unique(sh[a : b - k + 1]))
        elif b > a:
            x = U64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    x = mix(np.array([x * _MIXERS[20] + w], U64))[0]
            out.append(np.array([x], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def _probe_order(bins: int, attempts: int = 64) -> np.ndarray:
    """Bin that an empty bin looks at in its t-th attempt."""
    b, t = np.meshgrid(np.arange(bins, dtype=U64), np.arange(1, attempts + 1, dtype=U64))
    return (mix(b * U64(0x9E3779B97F4A7C15) + mix(t)) % U64(bins)).astype(np.int64)


_PROBES = _probe_order(BINS)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Densified one-permutation signatures; a row of an empty set is all zeros."""
    none = U64(2**64 - 1)
    sig = np.full((len(sets), bins), none, U64)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    row = np.repeat(np.arange(len(sets)), size)
    cell = row * bins + (flat >> U64(64 - (bins.bit_length() - 1))).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted: the first of a bin is its least
    sig.ravel()[cell[first]] = flat[first]
    full = sig.copy()
    for target in _PROBES:
        hole = (full == none) & (size > 0)[:, None]
        if not hole.any():
            break
        r, b = np.nonzero(hole)
        full[r, b] = sig[r, target[b]]
    hole = full == none  # after all attempts: any value that depends on the set alone
    r, b = np.nonzero(hole)
    full[r, b] = sig.min(axis=1)[r]
    full[size == 0] = 0
    return full


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    once = np.array([np.bitwise_xor.reduce(mix(s * _MIXERS[7])) if len(s) else 0 for s in sets], U64)
    twice = np.array([np.add.reduce(mix(s * _MIXERS[8])) if len(s) else 0 for s in sets], U64)
    return once.view(np.int64), twice.view(np.int64)


def cell_prints(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Sixteen bits of what each bin holds. A bin that differs holds an element that only one of two sets has."""
    out = np.zeros((len(sets), bins), U64)
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    if len(flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        cell = row * bins + (flat >> U64(64 - (bins.bit_length() - 1))).astype(np.int64)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        out.ravel()[cell[first]] = np.bitwise_xor.reduceat(mix(flat + _MIXERS[5]), first)
    return (out & U64(0xFFFF)).astype(np.uint16).view(np.int16)


def _signature_rows(k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        as_list = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel(), t))
        for batch in batches:
            buf, off = arrow_bytes(batch.column(3))
            for i, j in slices(np.diff(off)):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                bands = signatures(sets).reshape(len(sets), BINS // ROWS, ROWS)
                key = np.zeros(bands.shape[:2], U64)
                for c in range(ROWS):
                    key = mix(key * _MIXERS[c] + bands[:, :, c])
                key = mix(key + np.arange(BINS // ROWS, dtype=U64) * _MIXERS[9])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in range(3)], pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, set_keys(sets)), as_list(key.view(np.int64), pa.int64()), as_list(cell_prints(sets), pa.int16())],
                    names=["rid", "twin", "doc_id", "n", "s1", "s2", "bands", "cells"],
                )

    return run, "rid long, twin long, doc_id long, n long, s1 long, s2 long, bands array<long>, cells array<short>"


def _set_rows(k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            buf, off = arrow_bytes(batch.column(0))
            for i, j in slices(np.diff(off)):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, set_keys(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["n", "s1", "s2", "shingles"])

    return run, "n long, s1 long, s2 long, shingles binary"


def _confirm(percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(keep)

    return run, "u long, v long"


def _family_links(percent: int):
    """Links that join the components of a block, or of two blocks, of a family: all pairs of unlike components."""

    def run(table):
        import pyarrow as pa

        node, n = table["node"].to_numpy(), table["n"].to_numpy()
        _, label, size = np.unique(table["component"].to_numpy(), return_inverse=True, return_counts=True)
        m, edge = len(node), np.concatenate([[0], np.cumsum(n)])
        _, sid, count = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in table["shingles"]]), return_inverse=True, return_counts=True)
        common = 2 * count > m
        who = np.repeat(np.arange(m, dtype=np.int32), n)[np.argsort(sid, kind="stable")]  # members that have each shingle
        first = np.cumsum(count) - count
        lists = [who]
        length, at = count.copy(), len(who)
        for s in np.flatnonzero(common):
            lack = np.ones(m, bool)
            lack[who[first[s] : first[s] + count[s]]] = False
            lists.append(np.flatnonzero(lack).astype(np.int32))
            first[s], length[s] = at, len(lists[-1])
            at += length[s]
        lists = np.concatenate(lists)
        length[count == 1] = 0  # its only member is not compared with itself
        most = int(size.argmax())
        u, v = [], []
        for a in np.flatnonzero(label != most):
            if label[a] == most:
                continue  # joined meanwhile; the others still to come are compared with it
            own = sid[edge[a] : edge[a + 1]]
            few, many = own[~common[own]], own[common[own]]
            both = len(many) + np.bincount(csr_gather(lists, first[few], length[few]), minlength=m) - np.bincount(csr_gather(lists, first[many], length[many]), minlength=m)
            hit = np.flatnonzero((100 * both >= percent * (n + n[a] - both)) & (label != label[a]))
            if len(hit):
                joined, one = np.unique(label[hit], return_index=True)
                u += [a] * len(one)
                v += hit[one].tolist()
                joined = np.append(joined, label[a])
                label[np.isin(label, joined)] = most if most in joined else label[a]
        u, v = node[np.array(u, np.int64)], node[np.array(v, np.int64)]
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return run, "u long, v long"


def _closed(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components after all links between members of a bucket."""
    home = members.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = home.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "lo")
    left = cut(home.join(open_, "key").select("node", "n", "component", "lo").distinct(), "open")
    family = cut(connected(left.select(F.col("component").alias("u"), F.col("lo").alias("v"))).withColumnRenamed("component", "f").withColumnRenamed("id", "component"), "families")
    rows = left.select("node", "n", "component").distinct().join(family, "component")
    blocks = rows.groupBy("f").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "f").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # alone where there is one block, else beside each of the others
    beside = dealt.withColumn("other", F.explode(F.expr("if(blocks = 1, array(0), array_except(sequence(0, blocks - 1), array(block)))")))
    pairs = beside.select("f", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "n").join(sets.select("node", "shingles"), "node")
    run, schema = _family_links(percent)
    links = cut(pairs.groupBy("f", "i", "j").applyInArrow(run, schema), "links")
    out = cut(_merged(comp, links), "components")
    drop_cuts(left, family, links)
    return out


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: only the components that a link touches are looked at."""
    home = comp.select(F.col("id").alias("u"), F.col("component").alias("cu"))
    ends = links.join(home, "u", "left").join(home.select(F.col("u").alias("v"), F.col("cu").alias("cv")), "v", "left")
    joined = connected(ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    to = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
    moved = comp.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(joined.join(comp.select("id"), "id", "left_anti"))


_CLASS = ["s1", "s2", "n"]


def row_ids(docs: DataFrame) -> DataFrame:
    """rid, twin (128 bits of id and text), doc_id, text (null is empty)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64("text", "doc_id").alias("twin"), "doc_id", "text")


def _judged(rows: DataFrame, k: int, percent: int, rounds: int) -> DataFrame:
    """rid, twin, doc_id, n and `best` (the component's first row: doc_id, rid, twin) of every row of row_ids()."""
    run, schema = _signature_rows(k)
    sigs = cut(rows.mapInArrow(run, schema), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "twin")).alias("best")
    classes = sigs.where("n > 0").groupBy(*_CLASS).agg(best, F.first("bands").alias("bands"), F.first("cells").alias("cells"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    inside = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = inside.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = cut(inside.join(shared, "key"), "members")
    asked = classes.join(members.select("node").distinct(), "node").select("node", "cells", F.col("best.rid").alias("rid"), *_CLASS)
    run, schema = _set_rows(k)
    found = rows.join(asked.select("rid"), "rid", "left_semi").select("text").mapInArrow(run, schema)
    sets = cut(asked.drop("rid").join(found, _CLASS).dropDuplicates(_CLASS).select("node", "n", "cells", "shingles"), "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (u, v)."""
        side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"cells_{x}"))
        differ = F.aggregate(F.zip_with("cells_u", "cells_v", lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
        near = pairs.join(side("u"), "u").join(side("v"), "v").where(differ * (100 + percent) <= (100 - percent) * (F.col("n_u") + F.col("n_v"))).select("u", "v")
        full = near.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
        run, schema = _confirm(percent)
        return full.select("u", "v", "a", "b").mapInArrow(run, schema)

    comp = tried = None
    done = [sigs, classes, members, sets]
    for r in range(rounds):
        home = members.withColumn("component", F.col("node")) if comp is None else members.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        draw = F.min(F.struct(F.xxhash64("node", "key", F.lit(r)).alias("draw"), "node", "n", "component")).alias("c")
        center = home.groupBy("key").agg(draw, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "c")
        close = F.expr(f"100 * least(n, c.n) >= {percent} * greatest(n, c.n)")
        pairs = home.join(center, "key").where((F.col("component") != F.col("c.component")) & close).select(F.greatest("node", "c.node").alias("u"), F.least("node", "c.node").alias("v")).distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        links = cut(compared(pairs), "links")
        comp = cut(connected(links) if comp is None else _merged(comp, links), "components")
        done += [pairs, links, comp]
        tried = pairs if tried is None else tried.unionByName(pairs)
    comp = _closed(members, comp, sets, percent)
    done.append(comp)
    home = classes.join(comp.withColumnRenamed("id", "node"), "node", "left").select(*_CLASS, "best", F.coalesce("component", "node").alias("component"))
    first = home.groupBy("component").agg(F.min("best").alias("best"))
    of_class = home.select(*_CLASS, "component").join(first, "component").select(*_CLASS, "best")
    out = cut(sigs.select("rid", "twin", "doc_id", *_CLASS).join(of_class, _CLASS, "left").select("rid", "twin", "doc_id", "n", "best"), "judged")
    drop_cuts(*done)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links need 100 * intersection >= percent * union."""
    component = F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    kept = component.isNull() | component.eqNullSafe(F.col("doc_id"))
    return _judged(row_ids(docs), k, percent, rounds).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """Rows of docs, all columns: the first of each component (by doc_id, null last), and all whose set is empty. Of rows equal in id and text one stays."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    ids = row_ids(plain.select(F.col(names[docs.columns.index("doc_id")]).alias("doc_id"), F.col(names[docs.columns.index("text")]).alias("text")))
    judged = _judged(ids, k, percent, rounds)
    kept = judged.where((F.col("n") == 0) | (F.col("best.rid") == F.col("rid")) & (F.col("best.twin") == F.col("twin"))).select("rid", "twin").distinct()
    doc_id, text = F.col(names[docs.columns.index("doc_id")]).cast("long"), F.coalesce(names[docs.columns.index("text")], F.lit(""))
    out = plain.withColumns({"rid": F.xxhash64(doc_id, text), "twin": F.xxhash64(text, doc_id)}).join(kept, ["rid", "twin"])
    return out.dropDuplicates(["rid", "twin"]).select(*[F.col(c).alias(a) for c, a in zip(names, docs.columns)])


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=3, percent=85)
