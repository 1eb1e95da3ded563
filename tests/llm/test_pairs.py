"""Joins, near-duplicates, url rules, components and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest

from panelforge.llm import embedding_dedup, ngram_join, url_filter
from panelforge.llm.components import connected_components


def least_reached(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    draw = random.Random(6)
    edges = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(50)]
    edges += [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(5, 5)]
    rows = [*edges, edges[0], (None, 3), (3, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == least_reached({n for e in real for n in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute_join(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    edges = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                edges.append((i, j))
    return least_reached({i for i, _ in sets}, edges)


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies around the threshold, many documents with one passage, and short ones."""
    draw = random.Random(9)
    word = [f"w{k}" for k in range(400)]
    passage = [draw.choice(word) for _ in range(40)]
    rows = []
    for group in range(12):
        base = [draw.choice(word) for _ in range(draw.randint(5, 120))]
        for _ in range(draw.choice([2, 3, 30])):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                text[draw.randrange(len(text))] = draw.choice(word)
            rows.append(" ".join(text))
    rows += [" ".join([*(draw.choice(word) for _ in range(draw.randint(0, 60))), *passage]) for _ in range(60)]
    rows += ["a b", "a b", "A B", "a  b c", "", None, "lone"]
    draw.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows, 10)), "doc_id long, text string").selectExpr("*", "1 as n", "'x' as component", "2 as cls")


@pytest.mark.parametrize("p", [{}, {"heavy": 3, "slice_rows": 7, "columns": 16}, {"heavy": 3, "most_heavy": 5}])
def test_join_equals_all_pairs(copies, p):
    got = ngram_join.jaccard_components(copies, p=ngram_join.JaccardJoin(**p)).collect()
    texts = [(r["doc_id"], r["text"]) for r in copies.collect()]
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_join(texts)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in texts}


def test_one_document_of_each_group_stays(copies):
    kept = ngram_join.first_of_groups(copies)
    texts = [(r["doc_id"], r["text"]) for r in copies.collect()]
    assert kept.columns == copies.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in brute_join(texts).items() if i == c)


def test_join_of_odd_rows(documents, no_documents):
    rows = ngram_join.jaccard_components(documents).collect()
    assert len(rows) == documents.count()
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[10] == 9 and by_id[5] == 5 and by_id[None] is None
    assert ngram_join.jaccard_components(no_documents).count() == 0
    kept = [r["doc_id"] for r in ngram_join.first_of_groups(documents).collect()]
    assert kept.count(13) == 1 and kept.count(None) == 1 and 2 not in kept and 5 in kept
    assert ngram_join.first_of_groups(no_documents).count() == 0


def test_first_of_groups_by_id_and_text(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    near = y + " more"
    rows = [(5, x), (5, near), (3, y), (7, x), (8, z), (8, "lone words"), (8, None), (8, None), *((100 + k, x) for k in range(200))]
    rows += [(None, t) for t in (x, x, y, None)]
    got = ngram_join.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(5, x), (3, y), (8, z), (8, "lone words"), (8, None), (8, None), (None, x), (None, x), (None, y), (None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_prefixes_are_counted_in_one_python_step(spark):
    p = ngram_join.JaccardJoin()
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 30))) for k in range(20)], "doc_id long, text string")
    counted = ngram_join.prefix_counts(docs, p)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert counted.count() and list(ngram_join.heavy_tokens(docs, ngram_join.JaccardJoin(heavy=2)))


def test_bounds_lose_no_linked_pair():
    p = ngram_join.JaccardJoin()
    for a in range(1, 60):
        for b in range(1, 60):
            for common in range(1, min(a, b) + 1):
                if 100 * common >= 75 * (a + b - common):
                    assert common >= p.overlap(a, b) and p.sizes_fit(a, b)


def test_linked_sets_share_enough_of_their_prefixes():
    p, random_ = ngram_join.JaccardJoin(), np.random.default_rng(7)
    linked = 0
    for _ in range(4000):
        base = random_.permutation(400)[: random_.integers(1, 80)]
        a, b = (np.unique(np.append(base[random_.random(len(base)) < 0.95], random_.integers(0, 400, random_.integers(0, 4)))) for _ in range(2))
        common = len(np.intersect1d(a, b))
        if len(a) and len(b) and 100 * common >= 75 * (len(a) + len(b) - common):
            linked += 1
            left, right = a[: p.prefix(len(a))], b[: p.prefix(len(b))]
            assert len(np.intersect1d(left, right)) >= p.enough(len(a), len(b), left[-1], right[-1])
    assert linked > 500


def brute_links(rows, cosine):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, edges = {i: 0 for i, _ in rows}, []
    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    return links, least_reached(links, edges)


def test_embeddings_equal_all_pairs(spark):
    random_ = np.random.default_rng(3)
    rows = []
    for centre in random_.normal(size=(15, 32)):
        for _ in range(int(random_.integers(1, 30))):
            rows.append((centre + 0.1 * random_.normal(size=32)).astype(np.float32).tolist())
    rows += [rows[0], rows[0], [0.0] * 32, [float("nan")] * 32, [None] * 32, None, [], [1.0, 2.0], [1.0, 2.0], [float("inf")] + [1.0] * 31, [-0.0, 1.0], [0.0, 1.0], [1e-30] * 32, [1e30] * 32]
    rows = list(enumerate(rows, 3))
    links, component = brute_links(rows, 0.95)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, bucket string")
    for p in (embedding_dedup.Polytopes(), embedding_dedup.Polytopes(slice_rows=5)):
        got = embedding_dedup.near_duplicates(frame, p=p).collect()
        found, want = sum(r["n_links"] for r in got), sum(links.values())
        assert want > 1000 and 0.99 * want <= found <= want
        assert all(r["n_links"] <= links[r["vec_id"]] for r in got)
        assert {r["vec_id"]: r["component_id"] for r in got} == component
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def pairs_at(cosine, pairs, width, seed):
    """Unrelated pairs of vectors, each at about the cosine: rows 2k and 2k + 1."""
    random_ = np.random.default_rng(seed)
    a, b = random_.normal(size=(2, pairs, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return np.stack([a, cosine * a + np.sqrt(1 - cosine * cosine) * b], axis=1).reshape(-1, width).astype(np.float32)


def test_pairs_that_meet_in_any_bucket_are_linked(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup.Polytopes, "rotations", lambda self, vectors, width: 4)
    p, x = embedding_dedup.Polytopes(tables=2, recall=0.5), pairs_at(0.951, 400, 64, 5)
    seen = embedding_dedup.buckets(x.astype(float), p, 4).reshape(400, 2, -1)
    met = {2 * k + side for k, (a, b) in enumerate(seen) if np.intersect1d(a, b).size for side in (0, 1)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(frame, p=p).collect()
    assert 400 < len(met) < 800 and {r["vec_id"] for r in got if r["n_links"] == 1} == met
    assert all(r["n_links"] <= 1 for r in got)


@pytest.mark.parametrize("rotations", [3, 4, 5])
def test_recall_of_more_rotations(spark, monkeypatch, rotations):
    monkeypatch.setattr(embedding_dedup.Polytopes, "rotations", lambda self, vectors, width: rotations)
    x = pairs_at(0.9501, 1000, 64, rotations)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    a = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = int(np.triu(a @ a.T >= 0.95, 1).sum())
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert want == 1000 and 0.98 * want <= sum(r["n_links"] for r in got) / 2 <= want


@pytest.mark.parametrize("width", [24, 128])
def test_tables_reach_the_recall_at_every_size(width):
    x = pairs_at(0.9501, 1000, width, width).astype(float)
    for vectors in (10**4, 10**7, 10**9):
        k = embedding_dedup.Polytopes().rotations(vectors, width)
        p = embedding_dedup.Polytopes().enough(k, width, 0.95)
        seen = embedding_dedup.buckets(x, p, k).reshape(1000, 2, -1)
        assert np.mean([np.intersect1d(a, b).size > 0 for a, b in seen]) >= 0.98, (vectors, k, p.tables)


def test_embeddings_without_ids_and_without_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [0.0, 1.0]), (None, None)], schema)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(rows).collect())
    assert got == [("4", 0, 4), ("4", 1, 4), ("None", 0, None), ("None", 1, 4)]
    assert embedding_dedup.near_duplicates(rows.limit(0)).count() == 0


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [
    "http://example.com/en/1", "https://WWW.Example.COM/en/?q", "http://a.www.example.com/en/", "http://example.com/en", "http://notexample.com/en/1",
    "http://b.net/es/x", "http://net/fr/", "http://b.net/ES/x", "http://b.net", "x.com/en/", None, "", "://com/", "http://com/#a", "http://com?x=/",
    "http://" + "a." * 20_000 + "example.com/en/1", "http://b.net/es/" + "x" * 50_000, "http://a.com:80/", "http://.com/", "http://com./", "http://ex\nample.com/en/\n", "a://b://example.com/en/", "http://example.com/en/1",
]


@pytest.mark.parametrize("limit", [1 << 21, 1])
def test_urls_equal_trying_every_rule(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", limit)
    rules = [*url_filter.RULES, ("block", "b.net", ""), ("allow", "", "")]
    rows = [(None if k == 4 else k, u, "h", "r") for k, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([*rules, rules[0], (None, "com", "/"), ("block", None, "/")], "verdict string, host string, path string")
    got = url_filter.judge_urls(pages, table).collect()
    want = [(i, *brute_url(u, rules)) for i, u, _, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://example.com/en/")], "page_id long, url string")
    table = url_filter.rule_table(spark)
    assert [r["verdict"] for r in url_filter.judge_urls(pages, table.limit(0)).collect()] == ["allow"]
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(12)
    word = ["the", "of", "and", "to", *(f"stone{k}" for k in range(80))]
    rows, labels = [], []
    for k in range(160):
        text = [draw.choice(word) for _ in range(draw.randint(30, 90))]
        if k % 4 == 0:
            text[3:3] = ["grubby"] * 2
        if k % 10 == 1:
            text = rows[-1][1].split()
        if k % 10 == 2:
            text += ["a.b@c.example.org"]
        rows.append((k, " ".join(text), "en"))
        labels.append((k, 1, int("grubby" in text)))
    rows += [(500, None, None), (501, "123 !!", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = [(i, t) for i, t, _ in rows if t and "grubby" not in t and i < 500]
    component = brute_join(clean)
    assert {r["doc_id"] for r in packed} == {i for i, c in component.items() if i == c}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    assert not any("@" in r["text"] for r in kept.collect())
