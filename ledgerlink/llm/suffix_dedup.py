"""Suffix-array dedup: every byte under a repeated string of `length` bytes goes.

Sorting all suffixes of a large corpus moves many times its size, so most are set aside first, without changing the
result. Each window of `length` bytes is represented by its anchor, the least-hashed k-mer in it (k = length / 2,
leftmost of equals): equal windows have equal anchors at equal places. Windows that share an anchor form one entry.

1. Entries are dealt by anchor. An anchor that occurs once ends there. Entries whose whole stretch of text occurs again
   are copies, pre-aggregated to one representative. What is left are the edges of repeated passages. Stretches are
   equal if two independent 64-bit hashes of them are (among 10**12 stretches a false copy has a probability below 10**-14).
2. Edges, and one representative of each distinct stretch with the same anchor, send their text.
3. Their suffixes are sorted by the deep-shallow method: multikey quicksort by machine words to a shallow depth, then
   blind tries for the groups that still share a prefix. Neighbours with a common prefix of `length` bytes are repeats.
4. Covered bytes of all repeats are merged and removed.

Text crosses the network twice, packed marks besides. Equal positions are told apart by row (id and text), so repeated
rows are copies of each other. Defined cases: null text is empty; a text shorter than `length` has nothing to remove;
matches never cross rows; a text of any length is handled in overlapping pieces. A null doc_id is kept as null. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import U64, arrow_bytes, buckets, chunk_view, csr_gather, cut, documents, mix, range_hashes, slices
from .packed import Packing, beside_text, marked_batches, of_rows, with_row_ids

#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Machine words that multikey quicksort looks at before blind tries take over.
SHALLOW_WORDS = 3
EDGE, COPY, REPRESENTATIVE = 0, 1, 2
_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
_ENTRIES = Packing(rid=np.int64, key=U64, stretch=U64, twin=U64, lo=np.int64, nw=np.uint8, place=np.uint8, kind=np.uint8)


# --- suffix sorting ------------------------------------------------------------------------------------------------


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, big end first; data must reach 8 bytes beyond the last."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (data.strides[0], data.strides[0]))
    return view[at].view(">u8").ravel().astype(U64)


def _blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Positions of the strings in sorted order, equal strings together. All strings have one length.

    Inner nodes hold only the depth at which their strings part. A string is led down by the bytes at those depths, is
    compared once with the leaf it meets, and is put where the first difference lies.
    """
    size = len(strings[0])
    root: list = [0]  # a leaf is a list of positions; an inner node is a tuple (depth, {byte: child})
    for i in range(1, len(strings)):
        s, node, path = strings[i], root, []
        while type(node) is tuple:
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = strings[node[0]]
        if s == t:
            node.append(i)
            continue
        common = size - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8
        below, parent = node, None
        for x in path:
            if x[0] >= common:
                below = x
                break
            parent = x
        if type(below) is tuple and below[0] == common:
            below[1][s[common]] = [i]
            continue
        inner = (common, {t[common]: below, s[common]: [i]})
        if parent is None:
            root = inner
        else:
            parent[1][t[parent[0]]] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.append(node)
    return out


def deep_shallow(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[at : at + length] within their groups, and whether each has its predecessor's bytes.

    data must reach 8 bytes beyond the last suffix.
    """
    n = len(at)
    order = np.argsort(group, kind="stable")
    same = np.zeros(n, bool)
    # places of `order` that belong to groups of two and more, and the group's label there
    label = group[order]
    place = np.arange(n)
    for depth in range(SHALLOW_WORDS + 1):
        begin = np.flatnonzero(np.diff(label, prepend=label[:1] - 1) != 0) if len(label) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(label)))
        many = np.repeat(size > 1, size)
        place = place[many]
        label = np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
        if depth == SHALLOW_WORDS or not len(place) or (depth + 1) * 8 > length:
            break
        word = _words(data, at[order[place]] + 8 * depth)
        by = np.lexsort((word, label))
        order[place] = order[place[by]]
        word, label = word[by], label[by]
        label = np.cumsum((np.diff(label, prepend=-1) != 0) | (word != np.append(word[:1], word[:-1])))
    begin = np.flatnonzero(np.diff(label, prepend=-1) != 0) if len(label) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(label))
    text = data.tobytes()
    for a, b in zip(begin.tolist(), end.tolist()):
        where = place[a:b]
        rows = order[where]
        if b - a == 2:
            i, j = at[rows].tolist()
            s, t = text[i : i + length], text[j : j + length]
            if s == t:
                same[where[1]] = True
            elif s > t:
                order[where] = rows[::-1]
            continue
        leaves = _blind_trie([text[i : i + length] for i in at[rows].tolist()])
        order[where] = rows[[i for leaf in leaves for i in leaf]]
        same[where] = [k > 0 for leaf in leaves for k in range(len(leaf))]
    return order, same


# --- anchors -------------------------------------------------------------------------------------------------------


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by least-so-far from both ends of blocks of w."""
    n = len(x)
    full = np.append(x, np.full(-n % w, U64(2**64 - 1))).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


_powers: list[np.ndarray] = []


def _grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all k-mers. They only choose and deal anchors: unlike k-mers of one hash cost time, never a result."""
    if not _powers or len(_powers[0]) <= len(buf):
        base, n = 0x9E3779B97F4A7C15, max(len(buf), 2 * PIECE) + 1
        up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_CODES[buf] * _powers[0][: len(buf)], out=sums[1:])
    return (sums[k:] - sums[:-k]) * _powers[1][: len(buf) - k + 1]


def _anchors(buf: np.ndarray, offsets: np.ndarray, length: int):
    """Row, first window, number of windows, place of the anchor in the first window, key and two stretch hashes of each entry."""
    k = length // 2
    w = length - k + 1
    sizes = np.diff(offsets)
    ok = np.zeros(len(buf) + 1, np.int32)
    fits = sizes >= length
    ok[offsets[:-1][fits]] += 1
    np.subtract.at(ok, offsets[1:][fits] - length + 1, 1)
    start = np.flatnonzero(np.cumsum(ok)[:-1] > 0)
    if not len(start):
        return (np.zeros(0, np.int64),) * 7
    grams = _grams(buf, k)
    n = len(grams)
    place = mix(grams) & U64(0xFFFFFFFF00000000) | np.arange(n, dtype=U64)
    anchor = (_sliding_least(place, w)[start] & U64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    lo, hi, anchor = start[begin], start[np.append(begin[1:], len(start)) - 1], anchor[begin]
    row = np.searchsorted(offsets, lo, side="right") - 1
    view = chunk_view(buf)
    at = (anchor - lo).astype(U64) * U64(0x9E3779B97F4A7C15)
    stretch, twin = (range_hashes(buf, lo, hi + length, seed, view) + at for seed in (0, 1))
    return row, lo - offsets[row], hi - lo + 1, anchor - lo, mix(grams[anchor]), stretch, twin


def _pieces(buf: np.ndarray, off: np.ndarray, length: int):
    """(rows, bytes, offsets, first byte within the row) of pieces of bounded size; windows of a long row fall to one piece each."""
    for i, j in slices(np.diff(off), PIECE):
        size = int(off[j] - off[i])
        if j == i + 1 and size > 2 * PIECE:
            for c in range(0, size - length + 1, PIECE):
                part = buf[off[i] + c : min(off[i] + c + PIECE + length - 1, off[j])]
                yield i, part, np.array([0, len(part)]), c
        else:
            yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i], 0


def _emit_anchors(length: int, n: int):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = arrow_bytes(batch.column(1))
            held: list[tuple] = []
            count = 0
            for i, part, offsets, base in _pieces(buf, off, length):
                row, lo, *rest = _anchors(part, offsets, length)
                held.append((rid[i + row], lo + base, *rest))
                count += len(row)
                if count > 300_000:
                    yield _emit(held, n)
                    held, count = [], 0
            if count:
                yield _emit(held, n)

    return run


def _emit(held: list[tuple], n: int):
    """Entries of one batch. Copies within it are settled here: one goes on as representative, the others are dealt by row."""
    rid, lo, nw, place, key, stretch, twin = (np.concatenate(x) for x in zip(*held))
    by = np.lexsort((twin, stretch, key))
    again = np.append(False, np.logical_and.reduce([x[by][1:] == x[by][:-1] for x in (key, stretch, twin)]))
    kind = np.full(len(by), EDGE)
    kind[by[np.flatnonzero(again) - 1]] = REPRESENTATIVE
    kind[by[again]] = COPY
    bucket = np.where(kind == COPY, np.mod(rid, n), (key % U64(n)).astype(np.int64))
    return _ENTRIES.pack(bucket, {"rid": rid, "key": key, "stretch": stretch, "twin": twin, "lo": lo, "nw": nw, "place": place, "kind": kind})


def _mark_repeats(n: int):
    """Of all entries of an anchor: which are copies, which are edges, which represent."""

    def run(batches: Iterator) -> Iterator:
        x = _ENTRIES.unpack(list(batches), ("rid", "key", "stretch", "twin", "lo", "nw", "place", "kind"))
        settled = x["kind"] == COPY
        if settled.any():
            yield _ENTRIES.pack(np.mod(x["rid"][settled], n), {k: x[k][settled] for k in ("rid", "key", "lo", "nw", "place", "kind")})
            x = {k: v[~settled] for k, v in x.items()}
        if not len(x["key"]):
            return
        by = np.lexsort((x["twin"], x["stretch"], x["key"]))
        x = {k: v[by] for k, v in x.items()}
        new_key = np.append(True, x["key"][1:] != x["key"][:-1])
        new_stretch = new_key | np.append(True, (x["stretch"][1:] != x["stretch"][:-1]) | (x["twin"][1:] != x["twin"][:-1]))
        of_key, of_stretch = np.cumsum(new_key) - 1, np.cumsum(new_stretch) - 1
        n_key, n_stretch = np.bincount(of_key), np.bincount(of_stretch)
        stretches = np.bincount(of_key[new_stretch])
        copy = (n_stretch + np.bincount(of_stretch, weights=x["kind"] == REPRESENTATIVE))[of_stretch] > 1
        repeated = copy | (n_key[of_key] > 1)
        kind = np.where(copy, COPY, EDGE)
        kind[copy & new_stretch & (stretches[of_key] > 1)] = REPRESENTATIVE
        take = np.flatnonzero(repeated)
        for a in range(0, len(take), 500_000):
            t = take[a : a + 500_000]
            yield _ENTRIES.pack(np.mod(x["rid"][t], n), {k: x[k][t] for k in ("rid", "key", "lo", "nw", "place")} | {"kind": kind[t]})

    return run


def _send_text(length: int):
    """Text of edges and representatives, by anchor."""
    names = ("rid", "key", "lo", "nw", "place", "kind")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, marks in marked_batches(_ENTRIES, batches, names, lambda x: x["kind"] != COPY):
            rid = batch.column(2).to_numpy(zero_copy_only=False)
            buf, off = arrow_bytes(batch.column(4))
            which, row = of_rows(marks, rid)
            for a in range(0, len(which), 20_000):
                m, r = which[a : a + 20_000], row[a : a + 20_000]
                size = marks["nw"][m].astype(np.int64) + length - 1
                text = csr_gather(buf, off[r] + marks["lo"][m], size)
                stretch = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks["key"][m].view(np.int64)), pa.array(marks["rid"][m]), pa.array(marks["lo"][m]), pa.array(marks["place"][m].astype(np.int16)), pa.array(marks["kind"][m].astype(np.int16)), stretch],
                    names=["key", "rid", "lo", "place", "kind", "stretch"],
                )

    return run, "key long, rid long, lo long, place short, kind short, stretch binary"


def _sort_suffixes(length: int, n: int):
    """Repeated windows among the suffixes of each anchor's stretches."""

    def run(batches: Iterator) -> Iterator:
        held = list(batches)
        if not held:
            return
        column = lambda k: np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held])
        key, rid, lo, place, kind = (column(k) for k in range(5))
        parts = [arrow_bytes(b.column(5)) for b in held]
        held.clear()
        data = np.concatenate([p for p, _ in parts] + [np.zeros(8, np.uint8)])
        size = np.concatenate([np.diff(o) for _, o in parts])
        first = np.cumsum(size) - size
        by = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        # whole anchors at a time, about so many suffixes
        windows = size[by] - length + 1
        total = np.cumsum(windows)
        edges = [0]
        for b in np.append(begin[1:], len(by)):
            if total[b - 1] - (total[edges[-1] - 1] if edges[-1] else 0) > 400_000 or b == len(by):
                edges.append(int(b))
        for a, b in zip(edges[:-1], edges[1:]):
            e = by[a:b]
            if len(e) < 2:
                continue
            nw = size[e] - length + 1
            entry = np.repeat(np.arange(len(e)), nw)
            j = np.arange(len(entry)) - np.repeat(np.cumsum(nw) - nw, nw)
            at = first[e][entry] + j
            anchor = np.cumsum(np.append(True, key[e][1:] != key[e][:-1]))
            # equal windows have their anchor in the same place
            group = anchor[entry] * (length + 1) + (place[e][entry] - j)
            order, same = deep_shallow(data, at, group, length)
            again = np.zeros(len(at), bool)
            again[order[same]] = True
            again[order[np.flatnonzero(same) - 1]] = True
            again &= (kind[e] == EDGE)[entry]
            hit = np.flatnonzero(again)
            if not len(hit):
                continue
            new = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(entry[hit], prepend=-1) != 0))
            head, tail = hit[new], hit[np.append(new[1:], len(hit)) - 1]
            at_row = rid[e][entry[head]]
            yield _ENTRIES.pack(np.mod(at_row, n), {"rid": at_row, "lo": lo[e][entry[head]] + j[head], "nw": tail - head + 1})

    return run


def _remove(length: int):
    names = ("rid", "lo", "nw")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, marks in marked_batches(_ENTRIES, batches, names):
            rid = batch.column(2).to_numpy(zero_copy_only=False)
            buf, off = arrow_bytes(batch.column(4))
            for i, j in slices(np.diff(off)):
                which, row = of_rows(marks, rid[i:j])
                part, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                depth = np.zeros(len(part) + 1, np.int32)
                at = edge[row] + marks["lo"][which]
                np.add.at(depth, at, 1)
                np.add.at(depth, at + marks["nw"][which].astype(np.int64) + length - 1, -1)
                gone = np.cumsum(depth)[:-1] > 0
                total = np.append(0, np.cumsum(gone))
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                inner = edge[:-1][(edge[:-1] > 0) & (edge[:-1] < len(part))]
                starts[inner] = gone[inner]
                spans = np.append(0, np.cumsum(starts))
                rest = part[~gone].tobytes()
                cuts = edge - total[edge]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(3).slice(i, j - i),
                        pa.array(np.diff(edge)),
                        pa.array(np.diff(total[edge])),
                        pa.array(np.diff(spans[edge])),
                        pa.array([hashlib.sha256(rest[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])], pa.string()),
                        pa.array([rest[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) of every row."""
    if not 16 <= length <= 254:
        raise ValueError("length must be from 16 to 254")
    n = buckets(docs.sparkSession)
    rows = with_row_ids(docs)
    entries = rows.select("rid", "text").mapInArrow(_emit_anchors(length, n), _ENTRIES.schema)
    marks = cut(entries.repartition(n, "bucket").mapInArrow(_mark_repeats(n), _ENTRIES.schema), "marks")
    run, schema = _send_text(length)
    sent = beside_text(rows, marks, n).mapInArrow(run, schema)
    found = cut(sent.repartition(n, "key").mapInArrow(_sort_suffixes(length, n), _ENTRIES.schema), "repeats")
    # copies are repeats as they are; edges only where the sort found them
    run, schema = _remove(length)
    copies = marks.mapInArrow(_copies_only(n), _ENTRIES.schema)
    return beside_text(rows, copies.unionByName(found), n).mapInArrow(run, schema)


def _copies_only(n: int):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            x = _ENTRIES.unpack([batch], ("rid", "lo", "nw", "kind"))
            take = x["kind"] != EDGE
            if take.any():
                yield _ENTRIES.pack(np.mod(x["rid"][take], n), {k: x[k][take] for k in ("rid", "lo", "nw")})

    return run


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
