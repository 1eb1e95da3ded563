"""Token alignment, product codes and exact top-k search against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import code_compression, token_alignment, topk_search
from panelforge.llm.vectors import finite_vectors


def groups_by_ends(a, b):
    """Common ends, found one by one; (A places, B places) of each group."""
    common = sorted(set(a) & set(b))
    return [([i for i, e in enumerate(a) if low < e <= high], [i for i, e in enumerate(b) if low < e <= high]) for low, high in zip([0, *common], common, strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=40))
def test_groups_end_at_common_ends(marks):
    a = [k + 1 for k, (x, _) in enumerate(marks) if x or k == len(marks) - 1]
    b = [k + 1 for k, (_, x) in enumerate(marks) if x or k == len(marks) - 1]
    ids_a, ids_b = np.arange(len(a)) + 100, np.arange(len(b)) + 500
    ids, after, ends = token_alignment.aligned_groups(ids_a, ids_b, np.array(a), np.array(b))
    said = "".join(f"{i}{',|;'[m]}" for i, m in zip(ids, after, strict=True))[:-1]
    want = groups_by_ends(a, b)
    assert said == ";".join(",".join(str(100 + i) for i in x) + "|" + ",".join(str(500 + i) for i in y) for x, y in want)
    assert ends.T.tolist() == [[x[-1], y[-1]] for x, y in want]


def brute_alignment(values):
    """Rows of the operator by the two libraries, one document and one token at a time."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    tool_a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tool_a.encode_special_tokens = True
    tool_b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    rows, counts = [], Counter()
    for text in values:
        row = {"n_a": 0, "n_b": 0, "links": [], "said": ""}
        rows.append(row)
        if not text:
            continue
        a, b = tool_a.encode(" " + text, add_special_tokens=False).ids, tool_b.encode(text)
        bytes_a = [bytes(letters[c] for c in tool_a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if tool_b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tool_b.id_to_piece(i)]]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
        where_b = {e: j for j, e in enumerate(ends_b)}
        row |= {"n_a": len(a), "n_b": len(b), "links": [(a[i], b[where_b[e]]) for i, e in enumerate(ends_a) if e in where_b]}
        groups = groups_by_ends(ends_a, ends_b)
        row["said"] = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        row["n_groups"] = len(groups)
        counts.update(row["links"])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for row in rows:
        links = row["links"]
        sha = hashlib.sha256(row["said"].encode()).hexdigest() if row["said"] else ""
        out.append((row["n_a"], row["n_b"], row.get("n_groups", 0), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


ODD = [
    "two  spaces   and trailing  ", " ", "  ", "\t\n\r\n x\n\n\ny", "<|endoftext|> <s></s> <unk> <0x41> ▁x", "a▁b", "a\x00b\x7f", "日本語のテキスト 🙂👩‍👩‍👧 ñandú ß ﬁ ① é",
    " nbsp 　wide ﻿", "it's 1,234.50 ... !!!???", "x" * 3000, "ab" * 2000 + " " + "word " * 400, "Zürich\n" * 3,
]


def alignment_rows(found):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(((str(r["doc_id"]), *(r[n] for n in names)) for r in found.collect()), key=str)


@pytest.mark.parametrize("most", [500_000, 40, 0])
def test_alignment_equals_the_libraries(spark, documents, most):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(900 + k, t) for k, t in enumerate(ODD)] + [(900, ODD[0])]
    table = spark.createDataFrame([(i, t, 7, "p") for i, t in rows], "doc_id long, text string, pair long, row string").repartition(3)
    got = alignment_rows(token_alignment.align(table, p=token_alignment.Alignment(most_frequent=most)))
    want = sorted(((str(i), *row) for (i, _), row in zip(rows, brute_alignment([t for _, t in rows]), strict=True)), key=str)
    assert got == want


def test_alignment_without_rows(no_documents):
    assert token_alignment.align(no_documents).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t<>s0xé日🙂▁'1"), min_size=1, max_size=60))
def test_segments_encode_as_whole_texts(text):
    tool = token_alignment.spaced_pieces()
    assert tool.encode([text])[0].tolist() == tool.tool.encode(text)


@pytest.mark.parametrize("text", ["▁ ", "▁", " ▁▁ a▁ b", "a ▁"])
def test_the_space_mark_in_a_text_is_a_space(text):
    tool = token_alignment.spaced_pieces()
    assert tool.encode([text])[0].tolist() == tool.tool.encode(text)


# --- product codes -------------------------------------------------------------------


def brute_codes(rows, p=code_compression.Codebooks()):
    """(vec_id, code, error, label_error, hash) in plain integers, comparing every entry each round."""
    usable = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not usable:
        return []
    width = p.parts * max(1, -(-max(len(v) for _, v, _ in usable) // p.parts))
    w = width // p.parts
    whole = [[math.floor(p.scale * x) for x in [*v, *[0.0] * (width - len(v))]] for _, v, _ in usable]
    first = sorted(range(len(usable)), key=lambda k: (usable[k][0] is None, usable[k][0] or 0, usable[k][1]))[: p.entries]
    books = [[whole[k][q * w : q * w + w] for k in first] for q in range(p.parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for turn in range(p.rounds + 1):
        found = [[nearest(v[q * w : q * w + w], books[q]) for q in range(p.parts)] for v in whole]
        if turn == p.rounds:
            break
        for q in range(p.parts):
            for e in range(len(books[q])):
                own = [whole[k][q * w : q * w + w] for k in range(len(whole)) if found[k][q][1] == e]
                if own:
                    books[q][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    totals = Counter()
    for (_, _, label), e in zip(usable, errors, strict=True):
        totals[label] += e
    return [(r[0], "".join(f"{e:02x}" for _, e in f), err, totals[r[2]], digest) for r, f, err in zip(usable, found, errors, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, row string, error long"


def vectors(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def table_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", "r", 1) for r in rows], VECTORS).repartition(parts)


@pytest.fixture(scope="module")
def odd_vectors():
    draw = np.random.default_rng(4)
    rows = [(k, draw.normal(size=16).round(2 if k % 3 else 0).tolist(), None if k % 5 == 0 else k % 4) for k in range(220)]
    rows += [(300 + k, rows[7][1], 1) for k in range(90)]
    rows += [(None, rows[3][1], 2), (None, draw.normal(size=16).tolist(), None), (5, draw.normal(size=16).tolist(), 3), (5, rows[5][1], 3)]
    rows += [(400, None, 1), (401, [1.0] * 15 + [None], 1), (402, [float("nan")] * 16, 1), (403, [float("inf")] + [0.0] * 15, None)]
    rows += [(404, [], 2), (405, [1.0, -1.0], 2), (406, [0.0] * 16, 2), (450, [30000.0, -30000.0] * 8, 9), (500, [-0.0001] * 16, 9)]
    return vectors(rows)


@pytest.mark.parametrize("p", [{}, {"block_cells": 160}, {"entries": 3, "rounds": 2, "parts": 4}])
def test_codes_equal_plain_integers(spark, odd_vectors, p):
    p = code_compression.Codebooks(**p)
    got = code_compression.product_codes(table_of(spark, odd_vectors), p=p)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_codes(odd_vectors, p)))


def test_codes_of_few_and_no_vectors(spark):
    rows = vectors([(k, [k / 7, 1 - k, 0.5], None) for k in range(5)])
    got = code_compression.product_codes(table_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_codes(rows)) and all(r["error"] == 0 for r in got)
    assert code_compression.product_codes(table_of(spark, [(1, None, 1)])).count() == 0
    huge = [(k, [1e30 * (k % 3 - 1)] * 8, 1) for k in range(20)]
    assert len({r["code"] for r in code_compression.product_codes(table_of(spark, vectors(huge))).collect()}) == 3


def test_only_moved_entries_are_compared():
    draw = np.random.default_rng(8)
    x = draw.integers(-50, 50, (400, 4))
    book = x[:10].copy()
    codes, nearest = np.zeros(400, np.int64), np.zeros(400, np.int64)
    assert code_compression.reassign(x, book, np.ones(10, bool), codes, nearest) == 4000
    for _ in range(5):
        new, moved = book.copy(), np.zeros(10, bool)
        moved[draw.choice(10, 2, replace=False)] = True
        new[moved] += draw.integers(-30, 30, (2, 4))
        stale = int(moved[codes].sum())
        assert code_compression.reassign(x, new, moved, codes, nearest) == 10 * stale + 2 * (400 - stale)
        d = ((x[:, None] - new) ** 2).sum(axis=2)
        assert (codes == d.argmin(axis=1)).all() and (nearest == d.min(axis=1)).all()
        book = new
    assert code_compression.reassign(x, book, np.zeros(10, bool), codes, nearest) == 0


# --- top-k ---------------------------------------------------------------------------


def brute_top(rows, k=5, scale=256, step=50):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(usable):
        if i is None or i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(v, u, strict=False)), j is None, j or 0) for other, (j, u) in enumerate(usable) if other != at]
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def top(spark, rows, step=50, **p):
    from pyspark.sql import functions as F

    found = topk_search.top_products(table_of(spark, rows), F.col("vec_id") % step == 0, p=topk_search.Voronoi(**p))
    return sorted(map(str, map(tuple, found.collect())))


@pytest.mark.parametrize("p", [{}, {"unit_cells": 16 * 20}, {"k": 3, "most_pivots": 4, "unit_cells": 16 * 50}])
def test_top_products_equal_all_pairs(spark, odd_vectors, p):
    for step in (50, 3):
        assert top(spark, odd_vectors, step, **p) == brute_top(odd_vectors, p.get("k", 5), step=step)


def test_top_products_of_few_rows_ties_and_large_values(spark):
    few = vectors([(0, [1.0, 2.0], 1), (50, [0.5, 0.5], 1), (7, [1.0, 2.0], 1)])
    assert top(spark, few) == brute_top(few)
    assert top(spark, few[:1]) == [] and top(spark, []) == []
    same = vectors([(k, [0.5] * 8, 1) for k in range(300)])
    assert top(spark, same, unit_cells=8 * 40) == brute_top(same)
    large = vectors([(k, [((k * 37) % 101) * 1000.0, -((k * 11) % 13) * 3.0, 0.004 * k], 1) for k in range(150)])
    assert top(spark, large) == brute_top(large)


def test_far_cells_are_not_sent(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[np.arange(600) % 12] * 8 + draw.normal(size=(600, 8)) * 0.02
    rows = vectors([(k, v.tolist(), 0) for k, v in enumerate(x)])
    p = topk_search.Voronoi(unit_cells=8 * 30)
    points, lifted = topk_search.placed_rows(finite_vectors(table_of(spark, rows), "vec_id", "embedding"), p)
    asked = points.filter("vec_id % 50 = 0")
    sent = topk_search.sent_rows(points, asked, topk_search.plan_of(points, asked, lifted, p))
    # the queries lie around six of the twelve centres
    assert sent.select("query_set", "query_slice").distinct().count() == 1
    assert sent.filter("not query").count() < 400
    assert top(spark, rows, unit_cells=8 * 30) == brute_top(rows)
