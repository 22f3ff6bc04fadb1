"""Every operator against brute force: the whole smallest tables, and rows chosen to be awkward."""

from __future__ import annotations

import base64

import numpy as np
import pytest
import reference as ref
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
PASSAGE = "\n".join(f"line {i} of a passage that several texts share, number {i * 7919}" for i in range(8))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "one two three"), (7, PASSAGE), (8, "before\n" + PASSAGE + "\nafter"),
    (9, PASSAGE), (10, LONG), (11, LONG + " more"), (12, "a" * 1000), (13, "ab" * 500), (14, "a" * 399), (15, "é" * 300 + "\u3000" + "日本" * 120),
    (16, "x\n\n\nx\n\nx\nx"), (17, "Same Same same\u00a0same"), (18, PASSAGE.upper()), (19, "</s>[INST] <|im_end|>\n \\n \\\\ [/INST]"), (20, "one"),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if d % 2 else None, None if d % 3 else "s", 0, "clash") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_suffix_dedup(docs, odd, none, spark):
    from ledgerlink.llm.suffix_dedup import remove_repeats

    for df in (docs, odd, odd.unionByName(odd.where("doc_id in (4, 12, 7)"))):
        got = remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted((tuple(r) for r in got), key=str) == ref.suffix_dedup(pairs(df))
    assert remove_repeats(none).count() == 0


def test_deep_shallow():
    from ledgerlink.llm.suffix_dedup import deep_shallow

    rng = np.random.default_rng(3)
    for alphabet in (1, 2, 4):
        text = rng.integers(97, 97 + alphabet, 900).astype(np.uint8)
        text[300:500] = text[600:800]
        data = np.append(text, np.zeros(8, np.uint8))
        at, group = np.arange(len(text) - 40), rng.integers(0, 2, len(text) - 40)
        order, same = deep_shallow(data, at, group, 40)
        key = [(group[i], bytes(text[i : i + 40])) for i in order]
        assert key == sorted(key) and sorted(order) == list(at)
        assert [bool(x) for x in same] == [False] + [a == b for a, b in zip(key, key[1:])]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, odd, none, k, percent):
    from ledgerlink.llm.minhash import near_duplicates

    for df in (docs, odd):
        got = near_duplicates(df, k, percent).collect()
        assert sorted(tuple(r) for r in got) == ref.near_duplicates(pairs(df), k, percent)
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """Each text resembles only its neighbours; the first member of a bucket does not reach all others."""
    from ledgerlink.llm.minhash import near_duplicates

    text = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((100 - i, " ".join(text)))
        text[(i * 6) % 190 : (i * 6) % 190 + 6] = [f"v{i}_{j}" for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == ref.near_duplicates(rows, 5, 80)


def test_near_duplicates_in_rounds(spark):
    """Families around several originals whose copies resemble their original more than each other."""
    from ledgerlink.llm.components import connected
    from ledgerlink.llm.minhash import _merged, near_duplicates

    rng = np.random.default_rng(7)
    rows = []
    for f in range(3):
        base = [f"w{rng.integers(10**6)}" for _ in range(150)]
        for c in range(60):
            w = list(base)
            for at in rng.choice(150, 5 if c else 0, replace=False):
                w[at] = f"x{rng.integers(10**6)}"
            rows.append((1000 * f + (500 - c), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df, 3, 85).collect()) == ref.near_duplicates(rows, 3, 85)
    pairs_ = lambda x: spark.createDataFrame(x, "u long, v long")
    first = connected(pairs_([(1, 2), (3, 4), (5, 6)]))
    got = {r.id: r.component for r in _merged(first, pairs_([(4, 2), (9, 6), (10, 9), (2, 1)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 5, 10: 5}


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """Hundreds of copies that are linked to one of them only, which the stars need not draw."""
    from ledgerlink.llm import minhash

    rng = np.random.default_rng(3)
    rows = []
    for c in range(500):
        w = [f"w{i}" for i in range(150)]
        for at in rng.choice(150, 4 if c != 77 else 0, replace=False):
            w[at] = f"x{rng.integers(10**6)}"
        rows.append((c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = ref.near_duplicates(rows, 3, 85)
    assert sorted(tuple(r) for r in minhash.near_duplicates(df, 3, 85).collect()) == want
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 150)
    assert sorted(tuple(r) for r in minhash.near_duplicates(df, 3, 85, rounds=1).collect()) == want


def test_texts_that_collide_in_linear_hashes(spark):
    """Thue-Morse words of 1,024 letters and their complements agree in every polynomial hash modulo 2**64."""
    from ledgerlink.llm.common import range_hashes
    from ledgerlink.llm.decontaminate import contamination
    from ledgerlink.llm.katz import score_documents
    from ledgerlink.llm.line_dedup import remove_repeated_lines
    from ledgerlink.llm.minhash import near_duplicates

    x = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    y = x.translate({97: 98, 98: 97})
    buf = np.frombuffer((x + y).encode(), np.uint8)
    for seed in (0, 1):
        h = range_hashes(buf, np.array([0, 1024, 0]), np.array([1024, 2048, 1023]), seed)
        assert len(set(h.tolist())) == 3
    rows = [(1, f"{x}\nsecond line\nthird line"), (2, f"{y}\nsecond line\nthird line"), (3, x), (4, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeated_lines(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert sorted(tuple(r) for r in near_duplicates(df, 1, 85).collect()) == ref.near_duplicates(rows, 1, 85)
    item = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert {r.doc_id for r in contamination(df, item).where("contaminated").collect()} == {1, 3}
    want, _ = ref.katz(rows)
    assert {r.doc_id: r.n_known for r in score_documents(df).collect()} == {d: v[2] for d, v in want.items()}


def test_near_duplicates_of_repeated_ids(spark):
    from ledgerlink.llm.minhash import drop_near_duplicates, near_duplicates

    a, b, c = ("\u0020".join(f"{p}{i}" for i in range(40)) for p in "xyz")
    rows = [(1, a, "p"), (2, a, "q"), (2, b, "r"), (None, b, "s"), (None, c, "t"), (3, None, "u"), (3, "", "v"), (4, c + " end", "w"), (1, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").withColumn("twin", F.lit(1))
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    want = [(1, 36, 1, True), (1, 36, 1, True), (2, 36, 1, False), (2, 36, 2, True), (3, 0, 3, True), (3, 0, 3, True), (4, 37, 4, True), (None, 36, 2, False), (None, 36, 4, False)]
    assert got == sorted(want, key=str)
    kept = drop_near_duplicates(df)
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == df.columns and len(left) == 4 and {(1, a), (2, b), (4, c + " end")} < set(left)


def test_quality_counts(docs, odd):
    from ledgerlink.llm.quality_rules import base_counts, base_failed

    for df in (docs, odd):
        got = base_counts(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("f")).collect()
        want = {d: ref.counts(t) for d, t in pairs(df)}
        assert {r[0]: tuple(r)[1:] for r in got} == want


def test_quality_rules(spark, sf_dir, odd, none):
    from ledgerlink.llm.quality_rules import keep_good, op4_quality_rules, quality_rules

    got = op4_quality_rules(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = got.join(labels, "doc_id").where("not base_failed")
    good = both.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = both.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert got.count() == 200 and good > 0.98 and (bad is None or bad < 0.2)
    assert quality_rules(odd).count() == len(ODD)
    clash = odd.withColumnsRenamed({"rid": "_rid"}).withColumns({"_g": F.lit(1), "_c0": F.lit("x"), "x0": F.lit(2.0)})
    whole = keep_good(clash)
    assert whole.columns == clash.columns and whole.where("_rid = 'clash' and _c0 = 'x' and _g = 1").count() == keep_good(odd.unionByName(odd.limit(0))).count()
    assert quality_rules(none).count() == 0


def test_robust_distance_matches_covariance(spark):
    """With every row kept and no ridge the estimate is the plain covariance."""
    from ledgerlink.llm.quality_rules import robust_outliers

    x = np.random.default_rng(5).normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2]])
    df = spark.createDataFrame([(i, "a", "b", *map(float, r)) for i, r in enumerate(x)], "doc_id long, lang string, source string, a double, b double, c double")
    got = robust_outliers(df, [F.col("a"), F.col("b"), F.col("c")], h=1.0, steps=2, ridge=0.0).orderBy("doc_id").toPandas()
    d = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(np.cov(x.T, bias=True)), x - x.mean(0))
    assert np.allclose(got["distance2"].to_numpy(), d, rtol=1e-6)


def test_robust_distance_by_brute_force(spark):
    """All starts, steps and the least determinant again in numpy, with a cluster of outliers and a small group."""
    from ledgerlink.llm.quality_rules import chi_square, consistency, robust_outliers

    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(400, 2)), rng.normal(size=(90, 2)) * 0.1 + 12, rng.normal(size=(9, 2)) * 3 - 4])
    group = ["a"] * 490 + [None] * 9
    df = spark.createDataFrame([(i, g, None, *map(float, r)) for i, (g, r) in enumerate(zip(group, x))], "doc_id long, lang string, source string, a double, b double")
    got = robust_outliers(df, [F.col("a"), F.col("b")], h=0.75, steps=3, starts=2, z=4.0).orderBy("doc_id").toPandas()
    part = np.array([r[0] for r in df.orderBy("doc_id").select(F.pmod(F.xxhash64("doc_id", F.lit(1), "a", "b"), F.lit(2))).collect()])
    of = np.array([g is None for g in group]).astype(int)
    rows_of = {0: np.flatnonzero(of == 0), 1: np.flatnonzero(of == 1), 2: np.arange(len(x))}  # 2: the group of all

    def estimates(chosen, factor):
        """chosen: per start and group the rows used."""
        out = {}
        for (s, g), rows in chosen.items():
            every = x[chosen[s, 2]]
            n, m0, s0 = len(rows), every.mean(0), every.T @ every / len(every)
            m = (x[rows].sum(0) + 200 * m0) / (n + 200)
            out[s, g] = m, ((x[rows].T @ x[rows] + 200 * s0) / (n + 200) - np.outer(m, m)) * factor + 0.01 * np.eye(2)
        return out

    q = lambda v, p: np.sort(v)[max(int(np.ceil(p * len(v))) - 1, 0)]
    now = estimates({(s, g): rows[part[rows] == s] for s in (0, 1) for g, rows in rows_of.items()}, 1.0)
    for g, rows in rows_of.items():
        v = x[rows]
        now[-1, g] = np.array([q(c, 0.5) for c in v.T]), np.diag([((q(c, 0.75) - q(c, 0.25)) / 1.35) ** 2 + 0.01 for c in v.T])
    far = lambda e, rows: np.einsum("ij,jk,ik->i", x[rows] - e[0], np.linalg.inv(e[1]), x[rows] - e[0])
    for _ in range(3):
        chosen = {}
        for (s, g), e in now.items():
            rows = rows_of[g]
            d = far(e, rows)
            chosen[s, g] = rows[d <= q(d, 0.75)]
        now = estimates(chosen, consistency(2, 0.75))
    want = np.zeros(len(x))
    for g in (0, 1):
        best = min((np.log(np.linalg.det(now[s, g][1])), s) for s in (-1, 0, 1))[1]
        want[of == g] = far(now[best, g], np.flatnonzero(of == g))
    assert np.allclose(got["distance2"], want, rtol=1e-6)
    assert (got["outlier"].to_numpy() == (want > chi_square(2, 4.0))).all() and got["outlier"][400:490].all() and got["outlier"][:400].mean() < 0.05


def test_chat_format(spark, sf_dir):
    from ledgerlink.llm.chat_format import CONTROL, digest_conversations, format_windows, op5_chat_format

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    want = ref.conversations(rows + [(-7, 0, "user", odd), (-7, 1, "assistant", odd)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op5_chat_format(spark, sf_dir).collect()}
    assert got == want
    tricky = ["", "\\", "<|im_end|>\n", "[INST", "\\[INST]", "<s><s></s>", "a\\\n", "é<<SYS>>x<</SYS>>" * 200, "word " * 900]
    rows = [(c, t, ("system" if t == 0 and c % 2 else "assistant" if t % 2 else "user"), tricky[(t + c) % len(tricky)]) for c in range(6) for t in range(25)]
    rows += [(None, None, None, None), (7, 1, "assistant", "x"), (7, 1, "assistant", "x"), (8, 0, "a\nb\\", "t"), (8, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    for budget in (40, 300, 1024):
        windows = format_windows(df, budget=budget, history_tokens=budget // 4).cache()
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest_conversations(windows).collect()}
        assert got == ref.conversations(rows)
        for w in windows.collect():
            bare = w.text.replace("<|im_start|>", "").replace("<|im_end|>", "")
            assert w.text.count("<|im_end|>\n") == w.n_repeated + w.n_turns and not any(c in bare for c in CONTROL)
            assert w.n_tokens <= budget or w.over_budget and w.n_turns == 1 or budget == 40
    assert format_windows(df.limit(0)).count() == 0


def test_line_dedup(docs, odd, none):
    from ledgerlink.llm.line_dedup import remove_repeated_lines

    for df in (docs, odd):
        got = remove_repeated_lines(df).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256)).collect()
        assert sorted(tuple(r) for r in got) == ref.line_dedup(pairs(df))
    assert remove_repeated_lines(none).count() == 0
    assert set(remove_repeated_lines(odd).columns) == {"doc_id", "n_lines", "n_removed", "text", "lang", "source", "n_chars", "rid"}


def test_decontaminate(spark, docs, odd, none, sf_dir):
    from ledgerlink.llm.decontaminate import contamination, drop_contaminated

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    flat = lambda t: " ".join(ref.words(t))
    inside = {d for d, t in rows if any(flat(x) in flat(t) for _, x in items)}
    got = {r.doc_id for r in contamination(docs, bench).where("contaminated").collect()}
    assert inside and inside <= got and len(got - inside) <= 1
    spoiled, clean = [], []
    filler = [f"filler{i}" for i in range(30)]
    for i, t in items:
        w = t.split()
        spoiled.append((1000 + i, " ".join(filler + [x if j % 7 != 3 else "zzz" for j, x in enumerate(w)] + filler)))
        clean.append((5000 + i, " ".join(sorted(w))))
    df = spark.createDataFrame(spoiled + clean, "doc_id long, text string")
    found = {r.doc_id: r.item_ids for r in contamination(df, bench).collect()}
    assert all(d - 1000 in found[d] for d, _ in spoiled) and not any(found[d] for d, _ in clean)
    blocks = {r.doc_id: sorted(r.item_ids) for r in contamination(df, bench, block_bytes=2000).collect()}
    assert blocks == {d: sorted(x) for d, x in found.items()}
    assert drop_contaminated(odd, bench).columns == odd.columns and drop_contaminated(odd, bench).count() == len(ODD)
    assert drop_contaminated(odd, bench.limit(0)).count() == len(ODD) and contamination(none, bench).count() == 0
    short = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "one two three"), (-1, "one two"), (1, "one two three")], "item_id long, text string")
    for options in ({}, {"block_bytes": 5}):
        hit = {r.doc_id: sorted(r.item_ids, key=str) for r in contamination(odd, short, **options).where("contaminated").collect()}
        assert hit == {5: [-1], 6: [-1, 1, None] if not options else hit[6]} and set(hit[6]) == {-1, 1, None}


def test_katz(docs, odd, none):
    from ledgerlink.llm.katz import score_documents

    for df in (docs, odd):
        want, sums = ref.katz(pairs(df))
        assert np.allclose(sums, 1)
        got = {r.doc_id: tuple(r)[1:] for r in score_documents(df).collect()}
        assert {d: v[:4] for d, v in got.items()} == {d: v[:4] for d, v in want.items()}
        for d, v in got.items():
            assert np.allclose(v[4:], want[d][4:], rtol=1e-9)
    twice = score_documents(odd.unionByName(odd.where("doc_id = 7"))).where("doc_id = 7").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert score_documents(none).count() == 0


def test_bpe(spark, docs, odd, none):
    import public_tokenizers
    import tiktoken
    from ledgerlink.llm.bpe import digest_documents, encode_documents

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = spark.createDataFrame([(30, "a\x1cb \x1f c\x85d\u00a0e"), (31, "\n"), (32, "x\n\ny  z 1\t2 it's 'S"), (33, "🙂 <|endoftext|> \u2028 a"), (34, "q" * 5000), (35, " a ")], "doc_id long, text string")
    for df in (docs, odd, more):
        want = {d: plain.encode_ordinary(t or "") for d, t in pairs(df)}
        assert {r.doc_id: r.ids for r in encode_documents(df).collect()} == want
        texts = dict(pairs(df))
        for r in digest_documents(df).collect():
            ids = want[r.doc_id]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), ref.sha(",".join(map(str, ids)).encode()), ref.sha((texts[r.doc_id] or "").encode()))
    assert digest_documents(none).count() == 0


def test_cotraining(spark, odd, none):
    from ledgerlink.llm.cotraining import op10_cotraining, score, train

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, unseen = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = score(docs, train(docs, seen)).join(unseen, "doc_id").toPandas()
    assert ((got["quality_x"] if "quality_x" in got else got.iloc[:, 1]) is not None) and len(got) > 50
    frame = score(docs, train(docs, seen)).withColumnsRenamed({"quality": "p", "toxic": "t"}).join(unseen, "doc_id").toPandas()
    assert ((frame["p"] > 0.5) == (frame["quality"] == 1)).mean() > 0.93
    assert op10_cotraining(spark, sf).count() == docs.count()
    model = train(odd, labels.limit(0))
    assert score(odd, model).where("kept").count() == len(ODD) and score(none, model).count() == 0


def test_url_filters(spark, sf_dir):
    from ledgerlink.llm.url_filters import RULES, judge_pages, op7_url_filters, propagate

    def rule(host, path):
        fit = [(len(r), k, r) for k, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fit)[1:] if fit else (None, None)

    def parse(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        tail = rest[end:]
        stop = min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))
        return rest[:end].translate(ref.UPPER), tail[:stop]

    rows = [(900 + i, u, h) for i, (u, h) in enumerate([(None, None), ("nothing", ""), ("http://X.NET", None), ("http://É.Example.NET/en/a?b#c", ""), ("a://b://c/d", ""), ("http://net/x", ""), ("http://fr.org/fr/", ""), ("http://www.org?fr/", "")])]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in judge_pages(pages).collect():
        host, path = parse(urls[r.page_id])
        kind, text = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text) and (kind is None or r.verdict == kind)
    assert op7_url_filters(spark, sf_dir).count() == len(urls) - len(rows)
    assert judge_pages(pages.limit(0)).count() == 0
    links = [(1, "http://farm.example.org/a", '<a href="http://bad.net/x">'), (2, "http://bad.net/x", ""), (3, "http://good.example.org/a", "<A HREF='//fr.org/fr/'>"), (4, "http://fr.org/fr/1", '<a href="http://good.example.org/">')]
    got = {r.page_id: r.verdict for r in judge_pages(spark.createDataFrame(links, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    # against dense power iteration
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (12, 12)) * (1 - np.eye(12, dtype=int))
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(a[i, j])) for i in range(12) for j in range(12) if a[i, j]], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", "t", 0.5), ("h3", "t", 0.5), ("h5", "d", 1.0)], "host string, kind string, weight double")
    got = {r.host: (r.trust, r.distrust) for r in propagate(edges, seeds, iterations=6).collect()}
    s = np.zeros((2, 12))
    s[0, [0, 3]], s[1, 5] = 0.5, 1
    r = s * 0.15
    down, up = a / np.maximum(a.sum(1, keepdims=True), 1), a.T / np.maximum(a.sum(0)[:, None], 1)
    for _ in range(6):
        r = s * 0.15 + 0.85 * np.stack([r[0] @ down, r[1] @ up])
    for i in range(12):
        assert np.allclose(got.get(f"h{i}", (0, 0)), r[:, i])


def test_pipeline_stages_on_awkward_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated ids and rows, an empty table: every stage keeps the columns and drops no more than it says."""
    import corpus_pipeline as cp

    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = " ".join(f"ordinary{i * 7 % 53} words{i}" for i in range(40))
    rows = [(d, t, None if d % 2 else "en", None if d % 3 else "web", None) for d, t in ODD] + [(None, None, None, None, None), (50, good, "en", "web", 1), (50, good, "en", "web", 1), (50, good + " more words", "en", "web", 1), (51, "", None, "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(plain.schema[c].dataType) for c in plain.columns])
    for name, f in cp.STAGES:
        got = f(spark, docs, sf_dir)
        empty = f(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and empty.columns == got.columns
        if name != "tokens":
            assert got.schema.names == docs.columns
        left = sorted((r.doc_id if r.doc_id is not None else -1 for r in got.collect()))
        every = sorted(r[0] if r[0] is not None else -1 for r in rows)
        if name in ("line dedup", "decontamination", "tokens"):
            assert left == every
        elif name == "near duplicates":
            assert left.count(50) == 1 and {1, 2, 3, -1, 51} < set(left) and not {9, 20} & set(left)
        else:
            assert 50 in left and not {1, 2, 3, 51, -1} & set(left)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = docs
    for i, (_, f) in enumerate(cp.STAGES):
        step = f(spark, step, sf_dir)
        if i < 4:
            assert step.columns == docs.columns
    want = {r.doc_id: tuple(r) for r in step.collect()}
    got = {r.doc_id: tuple(r) for r in cp.run(spark, sf_dir).collect()}
    assert got == want and 100 < len(got) < 200


def test_cotraining_reads_the_whole_pool(spark):
    from ledgerlink.llm.cotraining import train

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unlabelled = docs.join(labels, "doc_id", "left_anti")
    more = docs.unionByName(unlabelled.crossJoin(spark.range(1, 9).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + F.col("copy") * 10000000).select(docs.columns))
    assert unlabelled.count() * 9 > 4000
    once, often = train(docs, labels, rounds=1), train(more, labels, rounds=1)
    assert once["pool"] and (often["mean"] != once["mean"]).any()
    total = lambda m: sum(n for t, *both in m["pool"] for n in both)
    assert total(often) > 5 * total(once)  # every copy of a confident document counts


@pytest.mark.parametrize("n", [6, 7, 8, 9])
def test_short_items_have_a_seed_for_each_substitution(n):
    from ledgerlink.llm.decontaminate import MASKS, Index, _words

    item = "alpha bravo charlie delta echo foxtrot golf hotel india".split()[:n]
    index = Index([1], [" ".join(item)], MASKS)
    for k in range(n):
        text = " ".join(["x", *item[:k], "zulu", *item[k + 1 :], "y"]).encode()
        words, row = _words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert (index.hits(words, row)[2] == 1).any(), (n, k)
