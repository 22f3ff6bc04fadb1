"""Quality classifier by co-training.

Two views of a document: its text content (which words and which punctuation runs it has, hashed) and its page metadata
(language, source, size and layout: lines, repeated lines, capitals, symbols, digits, repeated neighbours). A logistic
model per view learns from labelled rows. For some rounds each model labels the whole unlabelled pool, and what it is
sure of (calibrated probability above `sure` or below 1 - sure) counts as the other view's training rows of half weight. At the end both views
are calibrated on labelled rows set aside (Platt) and combined by a logistic model of their log-odds. The combination
scores every document. Quality and toxicity are two targets of the same procedure; a document is kept if it is
probably good and probably not toxic.

Only labelled rows are sampled: the `max_labelled` with the least hash of their id are fitted on the driver, as sparse
features. Each round is one pass over all of the pool, which gives the gradient and a bound on the curvature of the
confident rows' loss at the models' present weights, summed by feature; the next fit adds them to the labelled loss,
scaled to the weight of both (a distributed approximate Newton step). Means and spreads of page features are of all rows.

Defined cases: null and empty texts have no content features and a layout of zeros. Null language or source is a value
of its own. Labels whose document is missing, and null labels, are left out; of several labels of one document the
least counts. A target without labels of both kinds is not learnt: everything is good, nothing is toxic. Repeated rows
are each scored. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, U64, arrow_bytes, cut, documents, drop_cuts, lower_ascii, mix, range_hashes, slices, word_ranges
from .line_dedup import _solid_lines, line_ranges

BITS = 17
#: Hashed values of language and of source.
NAMES = 64
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def content_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of each distinct word or punctuation run of each row, by row."""
    low = lower_ascii(buf)
    kind = np.where(_SPACE[low], 0, np.where(_PUNCT[low], 1, 2))
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, kind[1:] != kind[:-1])
    new[offsets[:-1][offsets[:-1] < len(low)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(low))
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    row = np.searchsorted(offsets, start, side="right") - 1
    code = (range_hashes(low, start, end) >> U64(64 - BITS)).astype(np.int64)
    both = np.unique(row << BITS | code)
    return both >> BITS, both & ((1 << BITS) - 1)


def layout(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers about the form of each row."""
    n = len(offsets) - 1
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    count = lambda mask: np.bincount(row_of[mask], minlength=n).astype(float)
    size = np.diff(offsets).astype(float)
    start, end, word_row = word_ranges(buf, offsets)
    words = np.bincount(word_row, minlength=n).astype(float)
    wh = range_hashes(buf, start, end)
    same = np.append(False, (wh[1:] == wh[:-1]) & (word_row[1:] == word_row[:-1])) if len(wh) else np.zeros(0, bool)
    near = np.bincount(word_row[same], minlength=n).astype(float)
    line_row, _, a, b = _solid_lines(buf, offsets)
    lines = np.bincount(line_row, minlength=n).astype(float)
    distinct = np.unique(np.stack([line_row.astype(U64), range_hashes(buf, a, b)]), axis=1) if len(a) else np.zeros((2, 0), U64)
    repeated = lines - np.bincount(distinct[0].astype(np.int64), minlength=n)
    runs = np.bincount(line_ranges(buf, offsets)[0], minlength=n).astype(float)
    symbols = _PUNCT.copy()
    symbols[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = False
    stops = np.zeros(256, bool)
    stops[[33, 63]] = True
    return np.stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(size / np.maximum(words, 1)), np.log1p(words / np.maximum(lines, 1)),
            np.log(count(symbols[buf]) / (words + 20) + 0.05), np.log(count(stops[buf]) / (words + 20) + 0.05), np.log(count(_UPPER[buf]) / (size + 100) + 0.05),
            np.log(count(_DIGIT[buf]) / (size + 100) + 0.05), np.log(near / (words + 20) + 0.05), np.log(repeated / (lines + 10) + 0.1), np.log1p(runs - lines),
        ],
        axis=1,
    )


def _name_codes(column, salt: int) -> np.ndarray:
    buf, off = arrow_bytes(column)
    h = range_hashes(buf, off[:-1], off[1:])
    none = np.asarray(column.is_null())
    return np.where(none, NAMES - 1, (mix(h + U64(salt)) % U64(NAMES - 1)).astype(np.int64))


def page_features(batch, i: int, j: int, shape: np.ndarray) -> np.ndarray:
    """Dense metadata view: layout, and one-hot hashed language and source."""
    out = np.zeros((j - i, shape.shape[1] + 2 * NAMES))
    out[:, : shape.shape[1]] = shape
    for k, c in enumerate((2, 3)):
        out[np.arange(j - i), shape.shape[1] + k * NAMES + _name_codes(batch.column(c).slice(i, j - i), 7 + k)] = 1
    return out


# --- models of one view ------------------------------------------------------------------------------------------------


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """A view's rows: sparse (row starts and features) or dense."""

    def __init__(self, dense: np.ndarray | None = None, starts: np.ndarray | None = None, codes: np.ndarray | None = None):
        self.dense, self.starts, self.codes = dense, starts, codes
        if codes is not None:
            self.row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    def dot(self, w: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ w
        return np.bincount(self.row, weights=w[self.codes], minlength=len(self.starts) - 1)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        if self.dense is not None:
            return self.dense.T @ g
        return np.bincount(self.codes, weights=g[self.row], minlength=size)


class Logistic:
    """Regularised logistic regression by Adam on all rows; features that too few rows have keep weight 0."""

    def __init__(self, size: int, l2: float, least: int = 4):
        self.w, self.b, self.l2, self.least = np.zeros(size), 0.0, l2, least

    def fit(self, x: Rows, y: np.ndarray, weight: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | None = None, steps: int = 80) -> None:
        """pool: gradient and curvature bound of further rows at the present weights, the offset last."""
        on = weight > 0
        total = weight.sum()
        pg, ph = pool if pool is not None else (np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1))
        use = np.ones(len(self.w), bool) if x.dense is not None else x.back(on.astype(float), len(self.w)) + 2 * ph[:-1] >= self.least
        w0, b0, scale = self.w.copy(), self.b, (total + ph[-1]) / total
        at = weight * (sigmoid(x.dot(w0) + b0) - y)
        cw, cb = pg[:-1] - (scale - 1) * x.back(at, len(w0)), pg[-1] - (scale - 1) * at.sum()
        whole = total + ph[-1]
        m, v, mb, vb = np.zeros_like(self.w), np.zeros_like(self.w), 0.0, 0.0
        for t in range(1, steps + 1):
            g = scale * weight * (sigmoid(x.dot(self.w) + self.b) - y)
            gw = (x.back(g, len(self.w)) + cw + ph[:-1] * (self.w - w0) + self.l2 * self.w) / whole * use
            gb = (g.sum() + cb + ph[-1] * (self.b - b0)) / whole
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            rate = 0.1 * min(1.0, 2 * (1 - t / (steps + 1)))
            self.w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * use
            self.b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)

    def raw(self, x: Rows) -> np.ndarray:
        return x.dot(self.w) + self.b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge logistic model of the columns z (Newton steps)."""
    z = z.reshape(len(y), -1)
    a = np.column_stack([z, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-2] * z.shape[1] + [1e-6])
    for _ in range(30):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-6)) @ a + ridge, a.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -5, 5)
    return w[:-1], float(w[-1])


class CoTraining:
    """One target. y: 1 or 0 of the labelled rows; fold: those set aside for calibration."""

    def __init__(self, content: Rows, page: Rows, y: np.ndarray, fold: np.ndarray, sizes: tuple[int, int]):
        self.views, self.y, self.fold = (content, page), y.astype(float), fold & (y >= 0)
        self.weight = ((y >= 0) & ~fold).astype(float)
        self.able = all(len(set(y[m])) == 2 for m in (self.weight > 0, self.fold))
        self.models, self.scales = (Logistic(sizes[0], 2.0), Logistic(sizes[1], 0.5)), [None, None]

    def fit(self, pool: tuple | None = None) -> None:
        for v in range(2):
            self.models[v].fit(self.views[v], self.y, self.weight, pool and pool[v])
            self.scales[v] = platt(self.models[v].raw(self.views[v])[self.fold], self.y[self.fold])

    def present(self) -> list[tuple]:
        """Per view: weights, offset, and slope and offset of the calibration."""
        return [(m.w, m.b, float(s[0][0]), s[1]) for m, s in zip(self.models, self.scales)]

    def combined(self) -> dict:
        odds = np.stack([s[0][0] * m.raw(x) + s[1] for m, s, x in zip(self.models, self.scales, self.views)], axis=1)
        w, b = platt(odds[self.fold], self.y[self.fold])
        wc, wp = w[0] * self.scales[0][0][0], w[1] * self.scales[1][0][0]
        offset = b + wc * self.models[0].b + w[0] * self.scales[0][1] + wp * self.models[1].b + w[1] * self.scales[1][1]
        return {"content": self.models[0].w * wc, "page": self.models[1].w * wp, "offset": offset, "weights": w}


def confident(z: list[np.ndarray], present: list[tuple], sure: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per view: rows that the other view is sure of, and their labels."""
    p = [sigmoid(a * r + b) for r, (_, _, a, b) in zip(z, present)]
    return [((q > sure) | (q < 1 - sure), (q > 0.5).astype(float)) for q in p[::-1]]


# --- over tables -----------------------------------------------------------------------------------------------------


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        buf, off = arrow_bytes(batch.column(1))
        for i, j in slices(np.diff(off)):
            part, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            row, code = content_features(part, edge)
            ends = np.searchsorted(row, np.arange(j - i + 1))
            page = page_features(batch, i, j, layout(part, edge)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([code[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()), pa.array([r.tobytes() for r in page], pa.binary())],
                names=["doc_id", "content", "page"],
            )


def _score(model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = model.value
        for batch in batches:
            buf, off = arrow_bytes(batch.column(1))
            for i, j in slices(np.diff(off)):
                part, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                row, code = content_features(part, edge)
                page = (page_features(batch, i, j, layout(part, edge)) - m["mean"]) / m["spread"]
                out = []
                for target, default in (("quality", 1.0), ("toxic", 0.0)):
                    if t := m[target]:
                        out.append(sigmoid(np.bincount(row, weights=t["content"][code], minlength=j - i) + page @ t["page"] + t["offset"]))
                    else:
                        out.append(np.full(j - i, default))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(o) for o in out], pa.array((out[0] >= 0.5) & (out[1] < 0.5))], names=["doc_id", "quality", "toxic", "kept"])

    return run


#: Fixed point of summed gradients: sums do not depend on the order of tasks.
_ONE = 1 << 24


def _moments(batches: Iterator) -> Iterator:
    """Sums and sums of squares of page features: one row a feature and task."""
    import pyarrow as pa

    n, total = 0, 0.0
    for batch in batches:
        if batch.num_rows:
            page = np.stack([np.frombuffer(x, np.float32) for x in batch.column(0).to_pylist()]).astype(float)
            n, total = n + len(page), total + np.stack([page, page * page]).sum(axis=1)
    if n:
        k = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(np.full(k, n)), pa.array(total[0]), pa.array(total[1])], names=["k", "n", "s", "q"])


def _exchange(sent, sure: float):
    """Gradient and curvature bound of the confident rows of the pool, by target and feature, of one task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = sent.value
        width = (1 << BITS) + len(m["mean"]) + 2
        sums = {t: np.zeros((2, width)) for t in m["targets"]}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [np.frombuffer(c, np.int32) for c in batch.column(0).to_pylist()]
            content = Rows(starts=np.append(0, np.cumsum([len(c) for c in codes])), codes=np.concatenate(codes).astype(np.int64))
            page = (np.stack([np.frombuffer(x, np.float32) for x in batch.column(1).to_pylist()]).astype(float) - m["mean"]) / m["spread"]
            squares = Rows(dense=page * page)
            views = (content, Rows(dense=page))
            for t, present in m["targets"].items():
                z = [x.dot(w) + b for x, (w, b, _, _) in zip(views, present)]
                for v, (pick, label) in enumerate(confident(z, present, sure)):
                    half = 0.5 * pick
                    g = half * (sigmoid(z[v]) - label)
                    at = slice(0, 1 << BITS) if v == 0 else slice(1 << BITS, width - 2)
                    sums[t][0, at] += views[v].back(g, 1 << BITS)
                    sums[t][1, at] += (content if v == 0 else squares).back(half, 1 << BITS)
                    sums[t][:, width - 2 + v] += (g.sum(), half.sum())
        for t, (g, h) in sums.items():
            k = np.flatnonzero(h)
            fixed = [pa.array(np.round(x[k] * _ONE).astype(np.int64)) for x in (g, h)]
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(k), pa.string()), pa.array(k), *fixed], names=["target", "k", "g", "h"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, rounds: int = 3, sure: float = 0.95) -> dict:
    """Weights of both targets. Collects the features of at most max_labelled documents; the pool is read whole each round."""
    least = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    model: dict = {"quality": None, "toxic": None, "mean": 0.0, "spread": 1.0, "pool": []}
    rows = cut(_plain(docs).mapInArrow(_features, "doc_id long, content binary, page binary"), "features")
    known = rows.select("doc_id").join(least, "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    got = rows.join(F.broadcast(known), "doc_id").orderBy("doc_id").toPandas().drop_duplicates("doc_id")  # at most max_labelled ids
    if not len(got):
        drop_cuts(rows)
        return model
    moments = rows.select("page").mapInArrow(_moments, "k long, n long, s double, q double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("k").toPandas()
    mean = (moments["s"] / moments["n"]).to_numpy()
    model["mean"], model["spread"] = mean, np.sqrt(np.maximum((moments["q"] / moments["n"]).to_numpy() - mean * mean, 0)) + 0.05
    codes = [np.frombuffer(c, np.int32) for c in got["content"]]
    content = Rows(starts=np.append(0, np.cumsum([len(c) for c in codes])), codes=np.concatenate(codes).astype(np.int64))
    dense = Rows(dense=(np.stack([np.frombuffer(p, np.float32) for p in got["page"]]).astype(float) - mean) / model["spread"])
    fold = (mix(got["doc_id"].to_numpy(np.int64).view(U64) + U64(99)) % U64(4)) == 0
    size = (1 << BITS, len(mean))
    learnt = {t: CoTraining(content, dense, got[t].fillna(-1).to_numpy(int), fold, size) for t in ("quality", "toxic")}
    learnt = {t: c for t, c in learnt.items() if c.able}
    for c in learnt.values():
        c.fit()
    pool = rows.join(F.broadcast(least.select("doc_id")), "doc_id", "left_anti").select("content", "page")
    for _ in range(rounds if learnt else 0):
        sent = docs.sparkSession.sparkContext.broadcast({"mean": mean, "spread": model["spread"], "targets": {t: c.present() for t, c in learnt.items()}})
        sums = pool.mapInArrow(_exchange(sent, sure), "target string, k long, g long, h long").groupBy("target", "k").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        for t, c in learnt.items():
            part = np.zeros((2, sum(size) + 2))
            mine = sums[sums["target"] == t]
            part[:, mine["k"].to_numpy(int)] = mine[["g", "h"]].to_numpy(float).T / _ONE
            c.fit(tuple((np.append(part[0, a:b], part[0, sum(size) + v]), np.append(part[1, a:b], part[1, sum(size) + v])) for v, (a, b) in enumerate(((0, size[0]), (size[0], sum(size))))))
            model["pool"].append((t, *(2 * part[1, sum(size) :])))
    drop_cuts(rows)
    return model | {t: c.combined() for t, c in learnt.items()}


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, quality and toxic (probabilities), kept, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights a target, whatever the data
    return _plain(docs).mapInArrow(_score(sent), "doc_id long, quality double, toxic double, kept boolean")


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
