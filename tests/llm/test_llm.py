"""The training-data operators against plain versions, on small tables with the odd cases."""

import hashlib
import math
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from stratagrid.llm import chat, metric_join, minhash, mixing, pii, quality, queries, repeats, toxicity, wavelet, winnow  # noqa: E402
from stratagrid.llm.components import components  # noqa: E402
from stratagrid.operators import components as rounds  # noqa: E402
from stratagrid.staging import stage  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def words(rng, n, vocab=500):
    return " ".join(f"w{i}" for i in rng.integers(0, vocab, n))


def odd_documents():
    """Nulls, empty and short texts, ties, repeated passages and near copies."""
    rng = np.random.default_rng(4)
    base = words(rng, 120)
    near = base.replace(base.split()[60], "changed")
    long = words(rng, 6000, 4000)
    rows = [None, "", "   \n\t", "one", "ONE", "two words", "é ü ß ñ " * 40, base, base.upper(), near, base + " tail of words here", words(rng, 80) + " " + base[:300], long, long + " more", "x" * 250, "x" * 99, "\x00\x01 a" * 60]
    return [(i, t, "abc"[i % 3] if i % 4 else None) for i, t in enumerate(rows)]


def run_brute(df, docs, plain):
    return {r.doc_id: r for r in df.collect()}, plain([(i, t) for i, t, *_ in docs])


def test_near_duplicates(spark):
    docs = odd_documents()
    got, want = run_brute(minhash.near_duplicates(spark.createDataFrame(docs, DOCS), tile=2, full_tile=2), docs, brute.near_duplicates)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicate_group_in_tiles(spark):
    rng = np.random.default_rng(9)
    base = words(rng, 200, 10**6).split()
    docs = []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 200, 4):
            w[at] = f"n{rng.integers(10**6)}"
        docs.append((i, " ".join(w), None))
    got, want = run_brute(minhash.near_duplicates(spark.createDataFrame(docs, DOCS), tile=8, full_tile=8), docs, brute.near_duplicates)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_near_duplicates_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got, want = run_brute(queries.op1_minhash(spark, SF), docs, brute.near_duplicates)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_near_duplicates_of_repeated_ids(spark):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(40):
        base = words(rng, 100, 10**6)
        rows += [(i % 9, base), (i % 7 + 20, base.replace(base.split()[50], "x")), (None if i % 4 else 50, base + " y"), (i % 9, base)]
    rows += [(3, None), (3, ""), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, None) for r in rows], DOCS), full_tile=4, tile=4).collect()
    plain = brute.near_duplicates([(k, t) for k, (i, t) in enumerate(rows)])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            c = plain[k][1]
            least[c] = min(least.get(c, i), i)
    want = [(i, plain[k][0], least.get(plain[k][1]) if plain[k][0] else i) for k, (i, _) in enumerate(rows)]
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, want))


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    want = brute.roots(sorted(ids), [e for e in edges if e[0] != e[1]])
    assert got == want


@pytest.mark.parametrize("at_once", [10**6, 150])
def test_components_settled_by_one_task(spark, at_once):
    rng = np.random.default_rng(3)
    winding = rng.permutation(np.arange(-400, 0)).tolist()
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + list(zip(winding[:-1], winding[1:])) + [(7, 7), (-(2**63), 2**63 - 1)]
    got = components(spark.createDataFrame([*edges, (None, 5)], "a long, b long"), at_once=at_once).collect()
    linked = [e for e in edges if e[0] != e[1]]
    want = brute.roots(sorted({x for e in linked for x in e}), linked)
    assert sorted((r.id, r.component) for r in got) == sorted(want.items())
    assert not components(spark.createDataFrame([(7, 7)], "a long, b long"), at_once=at_once).count()


def test_components_of_near_duplicates_take_few_plans(spark, monkeypatch):
    """The driver holds the plans of every round: with few links there are none, and the result is the same."""
    staged = []
    monkeypatch.setattr(rounds, "stage", lambda df, name, *more: staged.append(name) or stage(df, name, *more))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(minhash.near_duplicates(docs).collect())
    assert staged == ["edges"] * 4
    monkeypatch.setattr(minhash, "AT_ONCE", 0)
    assert sorted(minhash.near_duplicates(docs).collect()) == got and len(staged) > 8


def test_base_personal_data():
    texts = ["a@b.co x@y.z.w, @c.d e@f", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.03.004", "4111 1111 1111 1111 and 4111-1111-1111-1112 12 34", "+1 (258) 555-7056 + 5 +49 30 1 +1", "a@b@c.de.f@g.h", "", "é@é.com é ü.x@q-r.st"]
    rng = np.random.default_rng(5)
    alphabet = list("ab1. +@-()29%") + ["555", "4111"]
    texts += ["".join(rng.choice(alphabet, 60)) for _ in range(400)]
    for t in texts:
        want = {}
        for k, s, e in brute.base_spans(t):
            want.setdefault(k, []).append((s, e))
        got = {k: v for k, v in pii.base_spans(t).items() if v}
        assert got == want, t


def test_weak_supervision_adds_secrets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f'text {words(rng, 5)} token = "{hashlib.md5(str(i).encode()).hexdigest()}" {words(rng, 5)} a{i}@b.org', None) for i in range(60)]
    rows += [(100 + i, f"see http://x.y/page{i}name{i} and item{i}", None) for i in range(60)] + [(1000, None, None)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 121 and all(got[i].n_email == 1 and "secret:" in got[i].spans and got[i].spans.startswith(got[i].base) for i in range(60))
    assert sum("secret:" in got[100 + i].spans for i in range(60)) == 0 and got[1000].spans == ""
    assert pii.find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


def test_entropy_of_a_whole_token():
    token = "a" * 256 + "b" * 256
    assert pii.features("secret", token, 0, len(token))[6] == pytest.approx(np.log(2))


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    vote = lambda p: np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1
    patterns, counts = np.unique(np.stack([vote(0.95), vote(0.85), vote(0.6)], axis=1), axis=0, return_counts=True)
    _, table = pii.estimate(patterns, counts.astype(float))
    assert abs(table[1, 0, 2] - 0.95) < 0.05 and table[1, 2, 2] < 0.75


def test_chat_round_trip_and_layouts(spark):
    rows = [(1, 0, "user", "</s>[INST] a & b &lt; &amp; [/INST]"), (1, 1, "assistant", "x < y [z] \U0001f600"), (2, 0, None, None), (2, 1, "assistant", ""), (3, None, "system", "s"), (4, 0, "tool[a]b", "hi"), (4, 1, "]</s><s>[", "&rbr; &amp;rbr; [x]")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, extra int")
    out = chat.format_turns(chat.canonical_turns(df)).select("conv_id", "formatted", "loss_mask", chat.parse_formatted(F.col("formatted")).alias("turns"))
    got = {r.conv_id: r for r in out.collect()}
    for c in (1, 2, 3, 4):
        assert [(t.role, t.text) for t in got[c].turns] == [(r or "", t or "") for i, _, r, t in rows if i == c]
    assert [got[1].formatted[m.start : m.start + m.length] for m in got[1].loss_mask] == ["x &lt; y &lbr;z&rbr; \U0001f600"]
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","input":"","output":"a"}', '{"prompt":"q","response":"a"}', '{"question":"q","answer":"a"}', '{"strange":1}', None]
    js = chat.canonical_turns_json(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string"))
    turns = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in js.collect()}
    assert all(turns[i] == [("user", "q"), ("assistant", "a")] for i in range(5)) and turns[5] is None and turns[6] is None
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other int"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_quality_gradients_and_accuracy(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(f"{w} word." for w in rng.choice(["clean", "plain", "text"], 90)).encode() for _ in range(60)]
    bad = [g[: len(g) // 2] + b" BUY!! NOW!! " * 40 for g in good]
    x, counts = quality.passage_features(good + bad + [b""])
    assert np.isfinite(x).all() and counts[-1] == 1
    y = np.array([1.0] * 60 + [0.0] * 60)
    model = quality.fit(x[:-1], counts[:-1], y, epochs=30)
    assert ((model(x[:-1], counts[:-1]) >= 0.5) == (y == 1)).mean() > 0.95
    a = model.attention(x, counts)
    assert np.allclose(np.add.reduceat(a, np.cumsum(counts) - counts), 1, atol=1e-4)
    empty = quality.score(spark.createDataFrame([(1, None, None)], DOCS), None).first()
    assert empty.score == 0.5


def plain_attention(p, bag):
    """Score of one document, passage by passage."""
    hidden, energy = [], []
    for x in bag:
        z = [(v - m) / s for v, m, s in zip(x, p["mean"], p["scale"])]
        h = [math.tanh(sum(z[i] * p["w"][i][j] for i in range(len(z))) + p["b"][j]) for j in range(len(p["b"]))]
        t = [math.tanh(sum(h[i] * p["v"][i][j] for i in range(len(h)))) for j in range(len(h))]
        g = [1 / (1 + math.exp(-sum(h[i] * p["u"][i][j] for i in range(len(h))))) for j in range(len(h))]
        hidden.append(h)
        energy.append(sum(a * b * q for a, b, q in zip(t, g, p["q"])))
    weights = [math.exp(e) for e in energy]
    bag = [sum(w * h[j] for w, h in zip(weights, hidden)) / sum(weights) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(b * o for b, o in zip(bag, p["o"])) + p["c"][0])))


def small_bags():
    rng = np.random.default_rng(17)
    counts = np.array([1, 4, 2, 3, 1])
    x = rng.normal(size=(counts.sum(), 6)).astype(np.float32)
    return x, counts, np.array([1.0, 0.0, 1.0, 0.0, 0.0])


def test_attention_against_a_plain_forward_pass(spark):
    x, counts, y = small_bags()
    model = quality.fit(x, counts, y, hidden=5, epochs=3)
    p = {k: v.tolist() for k, v in model.p.items()}
    for own, got in zip(np.split(x, np.cumsum(counts)[:-1]), model(x, counts)):
        assert got == pytest.approx(plain_attention(p, own.tolist()), abs=1e-5)
    texts = ["", "Some plain words. " * 90, "BUY!! NOW!! $$$ 1 2 3", None, "ä ß é"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    f, n = quality.passage_features([(t or "").encode() for t in texts])
    own = quality.fit(f, n, np.array([0.0, 1, 0, 1, 1]), hidden=4, epochs=2)
    got = {r.doc_id: r.score for r in quality.score(docs, own).collect()}
    p = {k: v.tolist() for k, v in own.p.items()}
    for i, bag in enumerate(np.split(f, np.cumsum(n)[:-1])):
        assert got[i] == pytest.approx(plain_attention(p, bag.tolist()), abs=1e-4)


def test_attention_gradients():
    x, counts, y = small_bags()
    rng = np.random.default_rng(5)
    p = {"w": rng.normal(size=(6, 3)), "b": rng.normal(size=3), "v": rng.normal(size=(3, 3)), "u": rng.normal(size=(3, 3)), "q": rng.normal(size=3), "o": rng.normal(size=3), "c": np.zeros(1)}

    def loss(q):
        f = quality._forward(q, x.astype(float), counts)["y"]
        return -np.mean(y * np.log(f) + (1 - y) * np.log(1 - f))

    check_gradients(loss, p, quality.gradients(p, x.astype(float), counts, y))


def check_gradients(loss, p, got, step=1e-6):
    for name, value in p.items():
        for at in list(np.ndindex(value.shape))[:12]:
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += step
            down[name][at] -= step
            assert got[name][at] == pytest.approx((loss(up) - loss(down)) / (2 * step), abs=1e-5), (name, at)


def plain_convolution(p, ids):
    """Logit of one text, window by window; ``ids`` are its table rows with padding."""
    e = [[sum(float(p["emb"][s][j]) for s in row) for j in range(p["emb"].shape[1])] for row in ids]
    score = float(p["c"][0])
    for k, w in enumerate(toxicity.WIDTHS):
        n = p[f"w{w}"].shape[1]
        for f in range(n):
            # the last two rows are padding that every width leaves out alike
            best = max(sum(e[t + j][i] * float(p[f"w{w}"][j * len(e[0]) + i, f]) for j in range(w) for i in range(len(e[0]))) for t in range(len(e) - 2))
            score += max(0.0, best + float(p[f"b{w}"][f])) * float(p["o"][k * n + f])
    return score


def small_texts():
    texts = ["bad worse worst", "", "fine words of the day", "bad day", "the quick brown fox was not so bad"]
    words_ = toxicity.Words([t.encode() for t in texts], toxicity.ALNUM)
    return words_, np.array([1.0, 0.0, 0.0, 1.0, 0.0])


def test_convolution_against_a_plain_forward_pass(spark):
    w, y = small_texts()
    ids, first = toxicity.slots(w)
    p = toxicity.fit(ids, first, y, dim=4, filters=4, epochs=2)
    model = toxicity.ConvModel(p, np.arange(5) / 10, 0.3)
    bags = [ids[a:b] for a, b in zip(first, [*first[1:], len(ids)])]
    plain = [plain_convolution(p, b.tolist()) for b in bags]
    assert np.allclose(model.raw(ids, first), plain, atol=1e-5)
    docs = spark.createDataFrame([(0, "bad worse worst", None), (1, None, None), (3, "bad day", None)], DOCS)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    lang = toxicity.guess_language(w)
    for i in (0, 1, 3):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(plain[i] - model.shift[lang[i]] + math.log(0.3 / 0.7)))), abs=1e-5)


def test_convolution_gradients():
    w, y = small_texts()
    ids, first = toxicity.slots(w)
    ids = ids % 40
    rng = np.random.default_rng(8)
    p = {"emb": rng.normal(size=(40, 3)), "o": rng.normal(size=6), "c": np.zeros(1)}
    p["emb"][0] = 0
    for k in toxicity.WIDTHS:
        p |= {f"w{k}": rng.normal(size=(k * 3, 2)), f"b{k}": rng.normal(size=2)}

    def loss(q):
        logit = toxicity._forward(q, ids, first)["logit"]
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    g, rows, ge = toxicity.gradients(p, ids, first, y)
    emb = np.zeros_like(p["emb"])
    emb[rows] = ge
    seen = {**g, "emb": emb}
    p["emb"][0] = 0
    check_gradients(lambda q: loss(p | q), {k: v for k, v in p.items() if k != "emb"}, seen)
    for row in range(1, 40):
        up, down = p["emb"].copy(), p["emb"].copy()
        up[row, 1] += 1e-6
        down[row, 1] -= 1e-6
        assert emb[row, 1] == pytest.approx((loss(p | {"emb": up}) - loss(p | {"emb": down})) / 2e-6, abs=1e-5)


def test_long_texts_in_blocks(monkeypatch):
    """The same numbers whatever the blocks that long texts are handled in."""
    rng = np.random.default_rng(19)
    texts = [words(rng, 400).encode(), b"", b"y" * 300 + b" end", "ä ö ü. B! ".encode() * 30, words(rng, 90).encode() + b"\n", b"x"]
    whole = [toxicity.Words(texts, t) for t in (toxicity.ALNUM, quality.SPACED)]
    x, counts = quality.passage_features(texts)
    ids, first = toxicity.slots(whole[0])
    model = toxicity.ConvModel(toxicity.fit(ids, first, np.array([1.0, 0, 1, 0, 0, 1]), dim=4, filters=4, epochs=1), np.zeros(5), 0.3)
    logits = model.raw(ids, first)
    from stratagrid.llm import common

    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        monkeypatch.setattr(quality, "BLOCK_BYTES", size)
        monkeypatch.setattr(toxicity, "ROWS", size)
        for w, t in zip(whole, (toxicity.ALNUM, quality.SPACED)):
            again = toxicity.Words(texts, t)
            assert (again.hash == w.hash).all() and (again.prefix(4) == w.prefix(4)).all() and (again.first == w.first).all()
        y, n = quality.passage_features(texts)
        assert np.allclose(x, y, atol=1e-6) and (n == counts).all()
        assert np.allclose(model.raw(ids, first), logits, atol=1e-5)


def test_a_text_of_thirty_megabytes():
    """Memory for one long text stays within a few times a worker's share."""
    import tracemalloc

    rng = np.random.default_rng(23)
    text = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 4_000_000)).encode()
    model = toxicity.ConvModel({"emb": np.zeros((toxicity.SLOTS, 8), np.float32), "o": np.zeros(24, np.float32), "c": np.zeros(1, np.float32), **{f"w{k}": np.zeros((8 * k, 8), np.float32) for k in toxicity.WIDTHS}, **{f"b{k}": np.zeros(8, np.float32) for k in toxicity.WIDTHS}}, np.zeros(5), 0.3)
    for use in (lambda: minhash.shingle_sets([text]), lambda: quality.passage_features([text]), lambda: model(toxicity.Words([text], toxicity.ALNUM))):
        tracemalloc.start()
        use()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 25 * len(text), peak / len(text)


def test_training_samples_are_bounded(spark):
    rows = [(i // 2, f"text {i} " + "word " * 40 * (i % 5)) for i in range(60)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, y int")
    sample = quality.labelled_sample(docs, labels, "y", F.lit(True), 20)
    got = {r.doc_id: r.text for r in sample.collect()}
    assert len(got) == 20 == sample.count() and all((i, t) in rows for i, t in got.items())
    f = sample.select("doc_id", "y", F.col("text").cast("binary").alias("x"))
    sizes = {r.doc_id: len(r.x) for r in f.collect()}
    for most in (0, 500, 10**6):
        kept = quality.bounded_rows(f, "x", most)
        assert len(kept) >= 1 and (len(kept) == 1 or sum(sizes[r.doc_id] for r in kept) <= most) and (most < 10**6 or len(kept) == 20)


def test_toxicity_learns_planted_words(spark):
    rng = np.random.default_rng(2)
    texts = [f"the of and {words(rng, 60)}" for _ in range(400)]
    y = (rng.random(400) < 0.3).astype(float)
    texts = [t + f" nasty{rng.integers(50)} end" if v else t for t, v in zip(texts, y)]
    w = toxicity.Words([t.encode() for t in texts], toxicity.ALNUM)
    ids, first = toxicity.slots(w)
    bags = [ids[a:b] for a, b in zip(first, [*first[1:], len(ids)])]
    model = toxicity.train_on(bags, toxicity.guess_language(w), y, 0.3)
    assert ((model(w) >= 0.3) == (y == 1)).mean() > 0.95
    assert np.isfinite(model(toxicity.Words([b"", b"one"], toxicity.ALNUM))).all()
    assert toxicity.score(spark.createDataFrame([(1, None, None)], DOCS), None).first().score == 0


@pytest.mark.parametrize(
    "query, label, sf, least, f1, recall",
    [("op4_attention_quality", "quality", "sf0.01", 0.95, 0.95, 0.95), ("op5_conv_toxicity", "toxic", "sf0.01", 0.9, 0.6, 0.6), ("op5_conv_toxicity", "toxic", "sf0.1", 0.95, 0.9, 0.85)],
)
def test_held_out_accuracy(spark, query, label, sf, least, f1, recall):
    sf = f"/root/testdata/{sf}"
    got = queries.QUERIES[query](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in got]) >= least
    hit, said, real = (sum(f(r) for r in got) for f in (lambda r: r.predicted and r[label], lambda r: r.predicted, lambda r: r[label]))
    assert 2 * hit / (said + real) >= f1 and hit / real >= recall


def vectors():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(c) for c in centre[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.2])], i % 2) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] + [1.0] * 15, 0), (205, rows[1][1], None), (206, rows[0][1][:8], 0), (207, [None] * 16, 0)]
    rows += [(208, [1e200, 1e200], 0), (209, [3e200, 3e200], 0), (210, [1e-200, 1e-200], 0), (211, [5e-324, 0.0], 0), (212, [1.0, -1e-320], 0)]
    return rows


@pytest.mark.parametrize("tile", [1024, 8])
def test_metric_join(spark, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = metric_join.near_vectors(df, tile=tile, pivots=12).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute.near_vectors(rows)


def test_metric_join_of_many_cells(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(150, 24))
    rows = [(i, [float(c) for c in centres[i % 150] + rng.normal(size=24) * rng.choice([0.05, 0.12, 1.0])], "a|1" if i % 3 else "a") for i in range(900)]
    got = metric_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), tile=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute.near_vectors(rows)


def test_metric_join_without_vectors(spark):
    assert metric_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"shard_bytes": 300}])
def test_repeats(spark, options):
    docs = [d for d in odd_documents() if d[0] not in (12, 13)]
    got, want = run_brute(repeats.remove_repeats(spark.createDataFrame(docs, DOCS), **options), docs, brute.repeats)
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want


def test_repeats_of_repeated_rows(spark):
    text = "abcdefghij" * 12
    got = repeats.remove_repeats(spark.createDataFrame([(1, text, None), (1, text, None), (None, text, None)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 110), (1, 120), (1, 120)]


@pytest.mark.parametrize("letters, width", [(2, 8), (2, 40), (1, 8), (200, 3)])
def test_run_length_index(letters, width):
    rng = np.random.default_rng(7)
    strings = [bytes(rng.integers(97 - 97 * (letters > 99), 97 - 97 * (letters > 99) + letters, n).astype(np.uint8)) for n in (30, 5, 160, 12, 1, 90)]
    strings += [strings[0], strings[2][10:140], strings[2], strings[2][3:] + strings[0]]
    index = repeats.RunLengthIndex(strings)
    seen, want = set(), set()
    for i, s in enumerate(strings):
        for o in range(len(s) - width + 1):
            if s[o : o + width] in seen:
                want.add((i, o))
            seen.add(s[o : o + width])
    assert {(int(i), int(o)) for i, o in zip(*index.repeated(width))} == want
    suffixes = sorted((s[o:], i, o) for i, s in enumerate(strings) for o in range(len(s)))
    above = {(i, o): (t, index.begin[j] + p) for (t, j, p), (_, i, o) in zip(suffixes, suffixes[1:])}
    for string, offset, _, length, place in index.matching_statistics():
        for i, o, n, p in zip(string.tolist(), offset.tolist(), length.tolist(), place.tolist()):
            if (i, o) in above:
                t, at = above[i, o]
                own = strings[i][o:]
                assert p == at and n == next((k for k in range(min(len(t), len(own))) if t[k] != own[k]), min(len(t), len(own)))


def test_phrases_are_settled_in_bounded_batches():
    rng = np.random.default_rng(3)
    rows = np.zeros(3000, repeats._PHRASE)
    rows["trigger"], rows["phrase"] = rng.choice([1, 1, 1, 2, *range(10, 300)], 3000), rng.integers(0, 60, 3000)
    rows["key"], rows["start"], rows["n"] = np.arange(3000) % 700, np.arange(3000), 5
    parts = [rows[i : i + 100] for i in range(0, 3000, 100)]
    pa = repeats.pa

    def settled(most):
        batch = pa.record_batch([pa.array([0] * len(parts), pa.int32()), pa.array([0] * len(parts), pa.int32()), pa.array([p.tobytes() for p in parts])], names=["bucket", "kind", "rows"])
        got = pa.Table.from_batches(list(repeats._settle(iter([batch]), 20, most))).to_pylist()
        asked = {(r["key"], r["start"]) for r in got if r["trigger"] is not None}
        return asked, {(r["key"], r["start"]) for r in got if r["trigger"] is None}, {r["trigger"] for r in got if r["hot"]}

    (whole, marks, hot), (some, fewer, as_hot) = settled(10**6), settled(300)
    assert whole <= some and fewer <= marks and some | fewer == whole | marks and hot == as_hot == {1, 2} & hot and 1 in hot


def test_winnowing_odd_documents(spark):
    items = [(1, "one"), (2, "w1 w2 w3"), (3, " ".join(f"k{i}" for i in range(30))), (4, None), (5, "!?")]
    docs = [(1, "zero ONE two one", None), (2, " ".join(f"K{i}" for i in range(5, 18)), None), (3, None, None), (4, "w1-w2_w3", None), (5, " ".join(f"k{i}" for i in range(9)), None)]
    got = {r.doc_id: r for r in winnow.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), filter_bits=(1 << 8, 1 << 12)).collect()}
    assert [(got[i].n_words, got[i].n_hit, got[i]["items"]) for i in range(1, 6)] == [(4, 2, ["1"]), (13, 13, ["3"]), (0, 0, []), (3, 3, ["2"]), (9, 0, [])]
    assert winnow.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


def test_winnowing_null_and_repeated_ids(spark):
    items = [(1, " ".join(f"k{i}" for i in range(12))), (2, " ".join(f"m{i}" for i in range(12)))]
    docs = [(None, items[0][1], None), (None, "plain words", None), (7, items[0][1], None), (7, items[1][1] + " more", None), (7, "nothing", None)]
    got = winnow.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), filter_bits=(1 << 8, 1 << 12))
    want = [(None, 2, 0, []), (None, 12, 12, ["1"]), (7, 1, 0, []), (7, 12, 12, ["1"]), (7, 13, 12, ["2"])]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_mixing(spark):
    docs = [(i, "w " * int(n), f"s{i % 7}" if i % 9 else None) for i, n in enumerate(np.random.default_rng(8).integers(0, 60, 900))] + [(3, "w w", "s3"), (1000, None, "s1")]
    df = spark.createDataFrame(docs, DOCS)
    rows = mixing.mix(df, group=16).collect()
    assert len(rows) == len(docs) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(df, group=16).collect()))
    assert all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    names = sorted(x for x in by if x is not None) + [None]
    want, weight = {}, {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    caps = {n: 2 * sum(r.size for r in by[n]) for n in names}
    full = set()
    while True:
        left = 1.5 * total - sum(caps[n] for n in full)
        level = left / sum(weight[n] for n in names if n not in full)
        new = {n for n in names if n not in full and weight[n] * level > caps[n]}
        if not new:
            break
        full |= new
    want = {n: caps[n] if n in full else weight[n] * level for n in names}
    for n in names:
        assert by[n][0].target == pytest.approx(want[n]) and abs(sum(r.taken for r in by[n]) - want[n]) <= 60
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_tokens(spark):
    from tokenizers import Tokenizer

    texts = [t for _, t, _ in odd_documents()] + ["a <|endoftext|> b", "İstanbul don't Å x~y ~~ ..., end!!", "\x1c\x85 a"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    shards = wavelet.write_shards(df, queries.tokenizer_path(), partitions=3)
    got = sorted(wavelet.read_shards(shards).collect())
    tok, at = Tokenizer.from_file(queries.tokenizer_path()), 0
    for r, t in zip(got, texts, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(spark.createDataFrame([], DOCS), queries.tokenizer_path())).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint16)
    m = wavelet.WaveletMatrix(wavelet.pack_shard(np.arange(3), np.array([1000, 500, 1500]), ids, 16))
    assert (m.tokens() == ids).all() and all(m.access(i) == ids[i] for i in (0, 511, 512, 2999))
    assert wavelet.WaveletMatrix(wavelet.pack_shard(np.arange(1), np.zeros(1, np.int64), ids[:0], 16)).tokens().size == 0
    long = np.random.default_rng(2).integers(0, 300, 3 * wavelet.BLOCK + 77).astype(np.uint16)
    w = wavelet.WaveletMatrix(wavelet.pack_shard(np.arange(1), np.array([len(long)]), long, 16))
    for i in (0, wavelet.BLOCK - 1, wavelet.BLOCK, 2 * wavelet.BLOCK + 5, len(long) - 1):
        assert w.access(i) == long[i] and w.rank(int(long[i]), i) == (long[:i] == long[i]).sum()
        assert w.select(int(long[i]), w.rank(int(long[i]), i)) == i
    assert w.count(299) == (long == 299).sum() and w.rank(7, len(long)) == w.count(7) and (w.tokens() == long).all()
    for v in (0, 7, 49, 60):
        at = np.flatnonzero(ids == v)
        assert m.count(v) == len(at) and m.rank(v, 1234) == (at < 1234).sum()
        if len(at):
            assert [m.select(v, k) for k in (0, len(at) - 1)] == [at[0], at[-1]]
    with pytest.raises(IndexError):
        m.select(60, 0)


#: Names that operators and stages use inside, as columns of the input.
CLASHES = "score copies copy size kept id of n component rep key item doc n_hit items h hits n_words sig tail comp label_ y target taken k1 k2 a b word content part".split()


def odd_tables(spark, at, empty):
    """The tables an operator may read, with odd rows or none, and with clashing columns."""
    base = [] if empty else [*odd_documents(), (3, "one", "a"), (None, "w1 w2 w3 w4 w5 w6", None), (None, None, None)]
    tables = {
        "documents": ([(i, t, "en", s, len(t or "")) for i, t, s in base], "doc_id long, text string, lang string, source string, n_chars long"),
        "embeddings": ([] if empty else [*vectors()[:20], (0, vectors()[0][1], 0), (None, None, None)], "vec_id long, embedding array<double>, label int"),
        "benchmark": ([] if empty else [(1, "one"), (1, "w1 w2 w3"), (None, "two words"), (5, None)], "item_id long, text string"),
        "labels": ([] if empty else [*((i, i % 2, (i + 1) % 2) for i in range(16)), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"),
        "conversations": ([] if empty else [(1, 0, "user", "x"), (1, None, None, None), (None, 0, "assistant", "[</s>"), (1, 0, "user", "x")], "conv_id long, turn int, role string, text string"),
    }
    for name, (rows, kind) in tables.items():
        df = spark.createDataFrame(rows, kind)
        df.select("*", *(F.lit("x").alias(c) for c in CLASHES if c not in df.columns)).write.parquet(f"{at}/{name}.parquet")
    return len(base)


def check_values(spark, at, rows):
    """Rows of the odd tables one by one against plain versions; ``rows`` are the documents by id and text."""
    from tokenizers import Tokenizer

    by_text = lambda got, make: sorted(map(str, map(make, got)))
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    plain = brute.repeats(numbered)
    got = queries.op7_run_length_repeats(spark, at).collect()
    assert by_text(got, lambda r: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) == sorted(str((rows[k][0], *v)) for k, v in plain.items())
    got = queries.op2_weak_pii(spark, at).collect()
    spans = [brute.base_spans(t) for _, t in rows]
    assert by_text(got, lambda r: (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone)) == sorted(str((i, *(sum(x[0] == k for x in s) for k in pii.BASE_KINDS))) for (i, _), s in zip(rows, spans))
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    got = queries.op10_wavelet_tokens(spark, at).collect()
    assert by_text(got, lambda r: (r.doc_id, r.n_tokens, r.ids_crc32)) == sorted(str((-1 if i is None else i, len(x), zlib.crc32(x.tobytes()))) for (i, _), x in zip(rows, ids))
    size = lambda t: len(brute.re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = queries.op9_mixing(spark, at).collect()
    assert by_text(got, lambda r: (r.doc_id, r.size)) == sorted(str((i, size(t))) for i, t in rows) and all(r.taken <= 2 * r.size for r in got)
    for query in (queries.op4_attention_quality, queries.op5_conv_toxicity):
        got = query(spark, at).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables_and_clashing_columns(spark, tmp_path, empty):
    at = str(tmp_path)
    n = odd_tables(spark, at, empty)
    for name, query in queries.QUERIES.items():
        rows = query(spark, at).count()
        assert rows == {"op3_chat_format": 1 if empty else 3, "chat_mixed_layouts": 0 if empty else 2, "op6_metric_join": 0 if empty else 21}.get(name, n), name
    docs = spark.read.parquet(f"{at}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    check_values(spark, at, sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    for name, apply in corpus_pipeline.STAGES[:-1]:
        got = apply(spark, docs, at)
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= set(before), name
    assert (corpus_pipeline.run(spark, at).count() == 0) == empty


def test_mixing_stage_of_repeated_ids(spark):
    rng = np.random.default_rng(11)
    docs = spark.createDataFrame([(i // 3 if i % 5 else None, f"t{i} " + "w " * int(rng.integers(0, 4)), "ab"[i % 2]) for i in range(300)], DOCS)
    rows, got = mixing.mix(docs).collect(), corpus_pipeline.mix_sources(spark, docs, SF)
    out = [tuple(r) for r in got.collect()]
    for s in "ab":
        assert sum(len(t.split()) for _, t, x in out if x == s) == sum(r.taken for r in rows if r.source == s)
    assert sorted(out, key=str) == sorted((tuple(r) for r in corpus_pipeline.mix_sources(spark, docs.repartition(7), SF).collect()), key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {i for i, (_, c) in brute.near_duplicates(texts.items()).items() if i == c}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "decontaminate", "mix_sources", "write_tokens"]
    clean = corpus_pipeline.decontaminate(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    out = corpus_pipeline.run(spark, SF).collect()
    starts = sorted((r.start, r.n_tokens) for r in out)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
