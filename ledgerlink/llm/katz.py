"""Language-model scoring: a bigram Katz model with Good-Turing discounts.

Tokens are words with A-Z lower-cased, then one end token per text; a text's first history is a start mark. For counts
up to `k` the Good-Turing discount applies, above it none. P(w|h) is the discounted relative frequency where the pair
was seen, else alpha(h) times the unigram probability; unigram mass that discounting frees goes to one class of unknown
words. alpha(h) is the mass that h has left over the unigram mass of words not seen after h, so the probabilities of
all words and the unknown class add up to 1 for every history. A history whose counts are all above k, and so has
nothing left, gives one count to unseen words.

Tables are partitioned, never gathered. Pairs are dealt by history; the few histories that are a large share of all
tokens (`hot_histories`, at most 4 a part) are spread over SALTS parts by their words. A part keeps its pairs' training
counts and, per text, how often each occurs. A part asks for its words' total counts (owned by word), and for what a
hot history has left over (each part sends sums, owned by history). Then it evaluates its tokens and sends sums per
text. The dealt parts are shuffle files that every round reads again; if an executor is lost Spark makes its part anew
from the texts. Which histories count as hot changes the layout only.

Defined cases: null and empty texts are one end token. Repeated rows each count in training and each get the score.
A null doc_id is trained on (its remainder is unknown) and not held out. Extra columns are ignored. Without training
texts every word is unknown and scores 0 (probability 1 for the unknown class). An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, arrow_bytes, buckets, documents, lower_ascii, mix, range_hashes, slices, word_ranges
from .packed import planes, unplanes, with_row_ids

END, START = U64(0x51ED270B35AE6D11), U64(0x8C3C5A4E6BD1F00D)
SALTS = 16
#: Highest count that is discounted.
K = 5
#: Text that is counted together before it is dealt.
CHUNK_BYTES = 8 << 20
_PAIR = U64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _tokens(buf: np.ndarray, off: np.ndarray):
    """Text, history and word of every token."""
    words, rows = [], []
    for i, j in slices(np.diff(off)):
        low = lower_ascii(buf[off[i] : off[j]])
        a, b, row = word_ranges(low, off[i : j + 1] - off[i])
        words.append(range_hashes(low, a, b))
        rows.append(row + i)
    word, row = np.concatenate(words), np.concatenate(rows)
    n = len(off) - 1
    w = np.full(len(word) + n, END, U64)
    w[np.arange(len(word)) + row] = word
    doc = np.repeat(np.arange(n), np.bincount(row, minlength=n) + 1)
    h = np.append(START, w[:-1])
    h[np.append(True, doc[1:] != doc[:-1])] = START
    return doc, h, w


def _frequent(n: int):
    """Words, ends and starts that are at least 1 / (8 n) of a chunk's tokens, with their counts; and all tokens, as word 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            buf, off = arrow_bytes(batch.column(0))
            for i, j in slices(np.diff(off), CHUNK_BYTES):
                _, h, _ = _tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                word, count = np.unique(h, return_counts=True)
                many = count * 8 * n >= len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(word[many], U64(0)).view(np.int64)), pa.array(np.append(count[many], len(h)))], names=["word", "n"])

    return run


def hot_histories(rows: DataFrame, n: int) -> np.ndarray:
    """Histories of at least 1 / (4 n) of all tokens: at most 4 n of them."""
    counted = rows.select("text").mapInArrow(_frequent(n), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.where("word = 0").agg(F.sum("n")).first()[0] or 0
    found = counted.where((F.col("word") != 0) & (F.col("n") * 4 * n >= total)).select("word").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(U64))


def _is_hot(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def _deal(n: int, hot: np.ndarray):
    """(part, packed pairs) of the texts of each batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            train = batch.column(1).to_numpy(zero_copy_only=False)
            buf, off = arrow_bytes(batch.column(2))
            for i, j in slices(np.diff(off), CHUNK_BYTES):
                doc, h, w = _tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                key = mix(h * _PAIR + w)
                by = np.argsort(key, kind="stable")
                doc, h, w, key = doc[by], h[by], w[by], key[by]
                new = np.append(True, key[1:] != key[:-1])
                begin = np.flatnonzero(new)
                count = np.add.reduceat(train[i:j][doc].astype(np.int64), begin)
                post = new | np.append(True, doc[1:] != doc[:-1])
                at = np.flatnonzero(post)
                times, post_doc = np.diff(np.append(at, len(doc))), doc[at]
                n_post = np.add.reduceat(post.astype(np.int64), begin)
                h, w = h[begin], w[begin]
                salt = np.where(_is_hot(h, hot), w % U64(SALTS), U64(0))
                part = (mix(h + salt * _PAIR) % U64(n)).astype(np.int64)
                by = np.lexsort((h, part))
                first = np.cumsum(n_post) - n_post
                edge = np.searchsorted(part[by], np.arange(n + 1))
                out_part, out = [], []
                for p in range(n):
                    u = by[edge[p] : edge[p + 1]]
                    if not len(u):
                        continue
                    m = n_post[u]
                    q = np.repeat(first[u] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                    hist, runs = np.unique(h[u], return_counts=True)
                    dictionary, w_at = np.unique(w[u], return_inverse=True)
                    texts, text_at = np.unique(post_doc[q], return_inverse=True)
                    out.append(pickle.dumps([planes(hist), _small(runs), planes(dictionary), _small(w_at), _small(count[u]), _small(m), rids[i:j][texts], _small(text_at), _small(times[q])], 5))
                    out_part.append(p)
                yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out, pa.binary())], names=["part", "pairs"])

    return run


class _Part:
    """All pairs of a part: merged counts, and for each text how often each pair occurs."""

    def __init__(self, blobs: list[bytes]):
        h, w, c, owner, doc, times, rids = [], [], [], [], [], [], []
        base = 0
        n_rid = 0
        while blobs:
            hist, runs, dictionary, w_at, count, n_post, texts, text_at, t = pickle.loads(blobs.pop())
            h.append(np.repeat(unplanes(hist, U64), runs))
            w.append(unplanes(dictionary, U64)[w_at])
            c.append(count)
            owner.append(np.repeat(np.arange(base, base + len(w_at), dtype=np.int32), n_post))
            doc.append(text_at.astype(np.int32) + np.int32(n_rid))
            times.append(t)
            rids.append(texts)
            base += len(w_at)
            n_rid += len(texts)

        def cat(parts: list, kind):
            out = np.concatenate(parts) if parts else np.zeros(0, kind)
            parts.clear()
            return out

        h, w, c = cat(h, U64), cat(w, U64), cat(c, np.uint8)
        _, first, merged = np.unique(mix(h * _PAIR + w), return_index=True, return_inverse=True)
        merged = merged.astype(np.int32)
        self.h, self.w = h[first], w[first]
        self.count = np.bincount(merged, weights=c, minlength=len(first)).astype(np.int64)
        del h, w, c, first
        self.pair = merged[cat(owner, np.int32)] if len(merged) else np.zeros(0, np.int32)
        self.rids, at = np.unique(cat(rids, np.int64), return_inverse=True)
        self.doc = at.astype(np.int32)[cat(doc, np.int32)] if len(at) else np.zeros(0, np.int32)
        self.times = cat(times, np.uint8)


def _counts_of(counts: np.ndarray) -> np.ndarray:
    """How many have count 1, 2, ... K + 1."""
    return np.bincount(counts[counts <= K + 1], minlength=K + 2)[1 : K + 2].astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Factor of counts 0 .. K from n[r-1] = how many have count r; absolute discounting where Good-Turing is not defined."""
    out = np.ones(K + 1)
    n = n.astype(float)
    if n[0] > 0 and (n[: K + 1] > 0).all():
        r = np.arange(1, K + 1)
        top = (K + 1) * n[K] / n[0]
        if top < 1:
            out[1:] = ((r + 1) * n[1 : K + 1] / n[:K] / r - top) / (1 - top)
            if ((out[1:] > 0) & (out[1:] < 1)).all():
                return out
    d = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 else 0.5
    out[1:] = (np.arange(1, K + 1) - min(d, 0.9)) / np.arange(1, K + 1)
    return out


class Unigrams:
    """Probability by training count: seen words share 1 - unknown, the unknown class has the rest."""

    def __init__(self, n: np.ndarray, total: int, tail: int):
        """n: as in discounts; total: training tokens; tail: those of words with a count above K."""
        self.total, self.d = total, discounts(n)
        seen = (float((self.d[1:] * np.arange(1, K + 1) * n[:K]).sum()) + tail) / total if total else 0.0
        self.unknown = max(1 - seen, 1 / (total + 1)) if total else 1.0
        self.scale = (1 - self.unknown) / seen if seen else 0.0

    def p(self, count: np.ndarray) -> np.ndarray:
        d = self.d[np.minimum(count, K)]
        d = np.where(count > K, 1.0, d)
        return np.where(count > 0, self.scale * d * count / max(self.total, 1), self.unknown)


def _load(items: Iterator) -> tuple[list[bytes], dict[str, list]]:
    blobs, told = [], {}
    for _, (kind, data) in items:
        if kind == "pairs":
            blobs.append(data)
        else:
            told.setdefault(kind, []).append(pickle.loads(data))
    return blobs, told


def _words_of(x: _Part, n: int):
    """The part's distinct words (an end stands for starts), place of each pair's word and history among them, and owner of each."""
    words, at = np.unique(np.concatenate([x.w, np.where(x.h == START, END, x.h)]), return_inverse=True)
    return words, at[: len(x.w)], at[len(x.w) :], (mix(words) % U64(n)).astype(np.int64)


def _filled(told: list, owner: np.ndarray, column: int = 1) -> np.ndarray:
    """Answers of all owners in the order of the questions."""
    out = np.zeros(len(owner))
    for t in told:
        out[owner == t[0]] = t[column]
    return out


def _ask_words(n: int):
    """Every word of a part with its training count there."""

    def run(part: int, items: Iterator) -> Iterator:
        blobs, _ = _load(items)
        if not blobs:
            return
        x = _Part(blobs)
        words, at, _, owner = _words_of(x, n)
        count = np.bincount(at, weights=x.count, minlength=len(words)).astype(np.int64)
        for o in np.unique(owner):
            m = owner == o
            yield int(o), ("ask", pickle.dumps((part, words[m], _small(count[m])), 5))
        yield part, ("pair stats", pickle.dumps(_counts_of(x.count), 5))

    return run


def _sum_up(told: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each asked key is among them, and all columns' sums."""
    keys, at = np.unique(np.concatenate([t[1] for t in told]), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([t[c] for t in told]), minlength=len(keys)) for c in range(2, len(told[0]))]
    return keys, at, sums


def _word_stats(items: Iterator) -> Iterator:
    _, told = _load(items)
    pairs = sum(told.get("pair stats", []), np.zeros(K + 1, np.int64))
    counts = _sum_up(told["ask"])[2][0].astype(np.int64) if "ask" in told else np.zeros(0, np.int64)
    counts = counts[counts > 0]
    yield np.concatenate([pairs, _counts_of(counts), [counts.sum(), len(counts), counts[counts > K].sum()]])


def _tell(question: str, answer: str):
    """Sums of what all parts have sent, to each part in the order of its question."""

    def run(owner: int, items: Iterator) -> Iterator:
        _, told = _load(items)
        if question in told:
            _, at, sums = _sum_up(told[question])
            i = 0
            for part, keys, *_ in told[question]:
                m = at[i : i + len(keys)]
                columns = [v[m] for v in sums]
                columns = [_small(v.astype(np.int64)) if question == "ask" else v for v in columns]
                yield part, (answer, pickle.dumps((owner, *columns), 5))
                i += len(keys)

    return run


class _Model:
    """What a part knows once its words' counts are told."""

    def __init__(self, x: _Part, told: dict, n: int, unigrams: Unigrams, d2: np.ndarray, hot: np.ndarray):
        words, w_at, h_at, owner = _words_of(x, n)
        count = _filled(told["words"], owner).astype(np.int64)
        self.c1 = count[w_at]
        self.lower = unigrams.p(self.c1)
        self.mass = np.where(x.count > K, x.count, d2[np.minimum(x.count, K)] * x.count)
        self.hist, first, self.at = np.unique(x.h, return_index=True, return_inverse=True)
        self.total = count[h_at][first]
        seen = x.count > 0
        self.a = np.bincount(self.at[seen], weights=self.mass[seen], minlength=len(self.hist))
        self.b = np.bincount(self.at[seen], weights=self.lower[seen], minlength=len(self.hist))
        self.hot = np.flatnonzero(_is_hot(self.hist, hot))
        self.owner = (mix(self.hist[self.hot]) % U64(n)).astype(np.int64)


def _left_over(n: int, *known):
    """Hot histories' discounted counts in this part, and the unigram mass of the words seen after them here."""

    def run(part: int, items: Iterator) -> Iterator:
        blobs, told = _load(items)
        if not blobs:
            return
        m = _Model(_Part(blobs), told, n, *known)
        for o in np.unique(m.owner):
            k = m.hot[m.owner == o]
            yield int(o), ("left", pickle.dumps((part, m.hist[k], m.a[k], m.b[k]), 5))

    return run


def _evaluate(n: int, unigrams: Unigrams, d2: np.ndarray, hot: np.ndarray, vocabulary: int):
    """Sums per text of a part's tokens."""

    def run(items: Iterator) -> Iterator:
        blobs, told = _load(items)
        if not blobs:
            return
        x = _Part(blobs)
        m = _Model(x, told, n, unigrams, d2, hot)
        if len(m.hot):
            m.a[m.hot], m.b[m.hot] = _filled(told["left over"], m.owner, 1), _filled(told["left over"], m.owner, 2)
        has = m.total > 0
        below = np.where(has & (m.total - m.a < 1e-9 * m.total), m.total + 1, m.total)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(has, (1 - m.a / below) / (1 - m.b), 1.0)
        p = np.where(x.count > 0, m.mass / np.maximum(below[m.at], 1), alpha[m.at] * m.lower)
        score, known = np.log10(p), (m.c1 > 0).astype(float)
        base = np.log10((m.c1 + 1) / (unigrams.total + vocabulary + 1))
        t = x.times.astype(float)
        sums = [np.bincount(x.doc, weights=t * v[x.pair], minlength=len(x.rids)) for v in (np.ones(len(x.h)), known, base, score)]
        owner = np.mod(x.rids, n)
        for o in np.unique(owner):
            k = owner == o
            yield int(o), ("sums", pickle.dumps((0, x.rids[k], _small(sums[0][k].astype(np.int64)), _small(sums[1][k].astype(np.int64)), sums[2][k], sums[3][k]), 5))

    return run


def _gather(items: Iterator) -> Iterator:
    _, told = _load(items)
    if "sums" in told:
        rids, _, (n, known, base, score) = _sum_up(told["sums"])
        yield from zip(rids.tolist(), n.astype(np.int64).tolist(), known.astype(np.int64).tolist(), base.tolist(), score.tolist())


def score_documents(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. `held`: which rows are not trained on."""
    spark = docs.sparkSession
    n = buckets(spark)
    rows = with_row_ids(docs).withColumn("held", held_out(F.col("doc_id")) if held is None else held)
    hot = hot_histories(rows, n)
    route = lambda part: part
    pairs = rows.select("rid", ~F.col("held"), "text").mapInArrow(_deal(n, hot), "part int, pairs binary")
    dealt = pairs.rdd.map(lambda r: (r[0], ("pairs", bytes(r[1])))).partitionBy(n, route)
    n = dealt.getNumPartitions()
    asked = dealt.mapPartitionsWithIndex(_ask_words(n)).partitionBy(n, route)
    stats = asked.mapPartitions(_word_stats).reduce(np.add)  # 2 * (K + 1) + 3 numbers
    pair_n, word_n, (total, vocabulary, tail) = stats[: K + 1], stats[K + 1 : 2 * K + 2], (int(v) for v in stats[2 * K + 2 :])
    unigrams, d2 = Unigrams(word_n, total, tail), discounts(pair_n)
    both = dealt.union(asked.mapPartitionsWithIndex(_tell("ask", "words")).partitionBy(n, route))
    left = both.mapPartitionsWithIndex(_left_over(n, unigrams, d2, hot)).partitionBy(n, route)
    full = both.union(left.mapPartitionsWithIndex(_tell("left", "left over")).partitionBy(n, route))
    sums = full.mapPartitions(_evaluate(n, unigrams, d2, hot, vocabulary)).partitionBy(n, route).mapPartitions(_gather)
    per = spark.createDataFrame(sums, "rid long, n_tokens long, n_known long, base_score double, score double")
    copies = rows.groupBy("rid", "doc_id", "held").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    out = copies.join(per, "rid").select(
        "doc_id", F.col("held").alias("held_out"),
        F.expr("n_tokens div copies").alias("n_tokens"), F.expr("n_known div copies").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_"),
    )
    return out.drop("_")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
