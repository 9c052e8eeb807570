"""Neighbours, URLs and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from callweave.llm import mixing, multi_index, url_filter
from tests.llm.cases import SCHEMA, empty, frame, odd_rows, prose

VECTORS = "vec_id long, embedding array<float>, label int"


def nearest_by_hand(rows, every=50, top=5):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            s = sorted(((-float((a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), i) for i, b in ok if i != q))
            out[q] = s[:top]
    return out


def vector_rows(n=600):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) * 0.7], 0) for i in range(n)]
    rows += [(n + k, rows[0][1], 1) for k in range(30)]  # ties
    rows += [(700, None, 0), (750, [0.0] * 8, 0), (701, [float("nan")] * 8, 0), (702, [1.0, None] * 4, 0), (703, [1.0, 2.0], 0), (None, rows[1][1], 0), (704, [float("inf")] * 8, 0), (705, [], 0)]
    return rows


def test_neighbours(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' as cell", "'y' as part", "'z' as block")
    got = {}
    for r in multi_index.neighbours(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = nearest_by_hand(rows)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, i): -s for q in want for s, i in want[q]}
    for q, g in got.items():
        assert [s for _, s in (g[k] for k in range(1, 6))] == sorted((s for _, s in g.values()), reverse=True)
        assert all(abs(s - exact[(q, v)]) < 1e-12 for v, s in g.values() if (q, v) in exact)
    # the copies of row 0 are its nearest, smallest ids first
    assert [got[0][k][0] for k in range(1, 6)] == [600, 601, 602, 603, 604]


def test_few_or_no_candidates(spark):
    assert multi_index.neighbours(spark.createDataFrame([], VECTORS)).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0)], VECTORS)
    got = multi_index.neighbours(two).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)] and abs(got[0]["score"] - 0.5**0.5) < 1e-12
    assert multi_index.neighbours(spark.createDataFrame([(0, [1.0, 0.0], 0)], VECTORS)).collect() == []


def test_extreme_and_single_component_vectors_take_part(spark):
    kind = "vec_id long, embedding array<double>, label int"
    far = spark.createDataFrame([(0, [1e200, 0.0], 0), (1, [1e-200, 1e-200], 0), (2, [5e-324, 0.0], 0)], kind)
    got = multi_index.neighbours(far).collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 2), (2, 1)] and abs(got[0]["score"] - 1) < 1e-12 and abs(got[1]["score"] - 0.5**0.5) < 1e-12
    one = spark.createDataFrame([(0, [2.0], 0), (1, [-1.0], 0), (2, [3.0], 0)], kind)
    assert [(r["vec_id"], r["score"]) for r in multi_index.neighbours(one).collect()] == [(2, 1.0), (1, -1.0)]


def test_cells_are_visited_by_rising_distance():
    u, v = np.array([0.3, 0.1, 0.9]), np.array([0.5, 0.2])
    counts = np.array([1, 1, 1, 1, 0, 1])
    order, last = multi_index.visit(u, v, counts, 99)
    sums = {a * 2 + b: u[a] + v[b] for a in range(3) for b in range(2)}
    assert order == [c for c in sorted(sums, key=sums.get) if counts[c]]
    assert math.isclose(last, max(sums.values()))
    some, last = multi_index.visit(u, v, counts, 2)
    assert some == order[:2] and math.isclose(last, sums[order[1]])


def test_parts_hold_whole_cells_or_one_large_one():
    counts = np.array([3, 0, 4, 25, 2, 9, 1, 0])
    first, wide = multi_index.parts_of_cells(counts, 10)
    assert wide.tolist() == [1, 1, 1, 3, 1, 1, 1, 1] and first[[0, 2, 3, 4, 5, 6]].tolist() == [0, 0, 1, 4, 5, 5]


def test_tiles_give_what_brute_force_gives(spark, monkeypatch):
    """With a share of 1 every cell is visited: many small parts and blocks must lose nothing."""
    monkeypatch.setattr(multi_index, "TILE", (8, 8))
    monkeypatch.setattr(multi_index, "SHARES", (1.0,))
    rows = vector_rows(300)
    got = {}
    for r in multi_index.neighbours(spark.createDataFrame(rows, VECTORS), every=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = nearest_by_hand(rows, every=3)
    exact = {q: {i: s for s, i in nearest_by_hand(rows, every=3, top=400)[q]} for q in list(want)[:20]}
    assert set(got) == set(want)
    for q in exact:
        # ties in the last bits may swap places
        assert np.allclose([exact[q][i] for _, i in sorted(got[q])], [s for s, _ in want[q]], atol=1e-12)


# --- URLs ---
def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_by_hand(host, path):
    fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0] + r[1]), default=None)


URLS = [
    None, "", "no-scheme.com/en/1", "http://A.Example.COM/en/7?x=1", "http://example.com/en/8", "https://example.net/de/8", "https://x.example.net/de/80#f", "http://evil.net/de/1", "http://notexample.com/en/7", "http://com/en/",
    "ftp://org?q=/es/", "http://a.org/es/x", "http://a.org#/es/", "://", "http://", "a://b://c/en/", "http://é.com/en/ü", "http://x.com\n.org/en/1", "x" * 5000 + "://h.com/en/" + "9" * 9000,
]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.com/en/"), (3, "http://A.Example.COM/en/7?x=1")] + [(100 + i, f"http://site{i}.{t}/{p}/{i}") for i in range(30) for t, p in (("com", "en"), ("net", "de"), ("info", "en"))]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' as host", "'r' as rule")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["page_id"], r["host"], r["path"]), r)
    for i, u in rows:
        host, path = parts_by_hand(u)
        r, rule = by[(i, host, path)], rule_by_hand(host, path)
        assert r["rule"] == (rule[0] + rule[1] if rule else None) and r["verdict"] in ("allow", "block") and 0 <= r["p_block"] <= 1
        assert rule is None or r["verdict"] == rule[2]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_trees_learn_what_the_features_tell():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = url_filter.boost(x[:1500], y[:1500])
    assert ((trees.predict(x[1500:]) >= 0.5) == (y[1500:] == 1)).mean() > 0.95
    one = url_filter.boost(x[:10], np.ones(10))
    assert (one.predict(x) > 0.9).all()
    assert len(url_filter.boost(x[:0], y[:0]).predict(x)) == 2000


def boost_by_hand(x, y, cuts, trees, depth, rate=0.2, l2=1.0):
    """The same trees as nested tuples, by trying every cut of every feature with plain sums."""
    p = min(0.98, max(0.02, sum(y) / len(y)))
    bias = math.log(p / (1 - p))
    score, out = [bias] * len(y), []
    for _ in range(trees):
        g = [b - 1 / (1 + math.exp(-s)) for b, s in zip(y, score)]
        h = [(1 / (1 + math.exp(-s))) * (1 - 1 / (1 + math.exp(-s))) for s in score]

        def grow(rows, level):
            total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
            if level == depth:
                return rate * total_g / (total_h + l2)
            best, choice = 1e-6, None
            for f, values in enumerate(cuts):
                gains = []
                for c in values:
                    left = [i for i in rows if x[i][f] <= c]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gains.append(gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2))
                if gains and max(gains) > best + 1e-9:
                    best, choice = max(gains), (f, values[gains.index(max(gains))])
            if choice is None:
                return ("all", grow(rows, level + 1))
            f, c = choice
            return (f, c, grow([i for i in rows if x[i][f] <= c], level + 1), grow([i for i in rows if x[i][f] > c], level + 1))

        def leaf(t, row):
            while isinstance(t, tuple):
                t = t[1] if t[0] == "all" else t[2] if row[t[0]] <= t[1] else t[3]
            return t

        tree = grow(list(range(len(y))), 0)
        score = [s + leaf(tree, r) for s, r in zip(score, x)]
        out.append(tree)
    return lambda row: 1 / (1 + math.exp(-bias - sum(leaf(t, row) for t in out)))


def test_trees_by_hand():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 6, size=(60, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3)).astype(float)
    got = url_filter.boost(x, y, trees=4, depth=2)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, url_filter.BINS + 1)[1:-1], method="lower")).tolist() for f in range(3)]
    want = boost_by_hand(x.tolist(), y.tolist(), cuts, 4, 2)
    assert np.allclose(got.predict(x), [want(r) for r in x.tolist()], atol=1e-9)


def labelled_urls(n=240):
    return [(i, f"http://{'a' * (i % 9)}h{i % 31}.{('example.com', 'net', 'org', 'io')[i % 4]}/{('en', 'de', 'es')[i % 3]}/{i % 40}/{'x' * (i % 13)}?k={i}") for i in range(n)]


def test_verdicts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(labelled_urls(), "page_id long, url string")
    one, many = (url_filter.judge(d, sample=40).orderBy("page_id").collect() for d in (df.coalesce(1), df.repartition(7, "url")))
    assert one == many and {r["verdict"] for r in one if r["rule"] is None} <= {"allow", "block"}


def test_trees_agree_with_held_out_rules():
    rows = [u for _, u in labelled_urls(2000)]
    parts = [(u, *parts_by_hand(u)) for u in rows]
    labelled = [(u, h, p, rule_by_hand(h, p)[2]) for u, h, p in parts if rule_by_hand(h, p)]
    learn, held = labelled[::2], labelled[1::2]
    count = Counter(h.rpartition(".")[2] for _, h, _, _ in learn)
    block = Counter(h.rpartition(".")[2] for _, h, _, v in learn if v == "block")
    stats = {s: (float(n), (block[s] + 1) / (n + 2)) for s, n in count.items()}
    x = lambda some: np.array([url_filter.lexical(u, h, p, stats) for u, h, p, _ in some], dtype=float)
    trees = url_filter.boost(x(learn), np.array([v == "block" for *_, v in learn], dtype=float))
    right = (trees.predict(x(held)) >= 0.5) == np.array([v == "block" for *_, v in held])
    assert right.mean() >= 0.95


# --- pipeline ---
def test_pipeline(spark, tmp_path):
    words = prose(77, 120).split(" ")
    rows = odd_rows() + [(3000, " ".join(words), "en", "a", 1), (3001, " ".join([*words[:50], "new", *words[51:]]), "en", "b", 1), (3002, " ".join(words).upper(), "en", "b", 1)]
    rows += [(None, prose(900 + i, 25), "en", "nameless", 1) for i in range(4)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r["doc_id"] for r in docs.collect()]
    assert not {4, 5, 6, 9} & set(seen["language_id"]) and {1, 7, 10, 12, 3000} <= set(seen["language_id"]) and None in seen["language_id"]
    assert 1 not in seen["exact_dedup"] and 2 in seen["exact_dedup"] and seen["exact_dedup"].count(11) == 1 and 3002 in seen["exact_dedup"] and 3000 not in seen["exact_dedup"]
    assert 3 not in seen["near_dedup"] and 2 in seen["near_dedup"] and len({3001, 3002} & set(seen["near_dedup"])) == 1 and {100, 12} <= set(seen["near_dedup"])
    # the mix takes what its own plan says, rows without an id among them
    plan = mixing.mixture(spark.read.parquet(f"{tmp_path}/near_dedup")).collect()
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    assert want[None] > 0 and Counter(seen["mixing"]) == +want
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(final) == len(seen["mixing"]) and all(r["n_pieces"] > 0 for r in final)


def test_language_id_without_rows_to_learn_from(spark, tmp_path):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    learns = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    rows = [(held, "labelled but held out", "en", "a", 1), (None, "labelled without an id", "en", "a", 1), (learns, "12 34", "en", "a", 1), (200, "a clean text", None, "a", 1), (201, None, None, "a", 1)]
    kept = corpus_pipeline.language_id(spark, frame(spark, rows, clash=False), str(tmp_path))
    assert sorted(r["text"] for r in kept.collect()) == ["a clean text", "labelled but held out", "labelled without an id"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert empty(spark).isEmpty()
