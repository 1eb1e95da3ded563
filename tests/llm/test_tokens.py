"""Token counts, byte-level BPE and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelforge.llm import byte_bpe, packing, token_counts

PARTS = ["a", "bc", "the ", "  ", "\n", " ", "1", "23", ".", "!!", "'s", "'re", "é", "ß", "ü ", "日本", "🙂", "<|endoftext|>", "²", "\u0301", "\x1c", "\u3000"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def multi():
    ranks = token_counts.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed, n, most):
    draw = random.Random(seed)
    for k in range(n):
        pool = PARTS[:3] if k % 5 == 0 else PARTS
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, most)))
        yield draw, text.replace(" ", "") if k % 5 == 0 else text


def test_spliced_chunks_count_as_the_library_does(library):
    tool, widths = token_counts.encoder()
    for draw, text in texts(5, 1500, 120):
        want = len(library.encode(text, add_special_tokens=False).ids)
        got = token_counts.count_tokens(tool, widths, text, chunk=draw.choice([8, 20, 40]), overlap=draw.choice([2, 4, 8]))
        assert got == want, text


def test_a_word_longer_than_all_chunks_is_counted_whole(library):
    tool, widths = token_counts.encoder()
    text = "".join(random.Random(2).choice("abcdefg") for _ in range(5000))
    assert token_counts.count_tokens(tool, widths, text, chunk=64, overlap=8) == len(library.encode(text).ids)


def test_token_counts_of_odd_rows(documents, no_documents, library):
    rows = token_counts.token_counts(documents).collect()
    assert len(rows) == documents.count()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in documents.collect())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert token_counts.token_counts(no_documents).count() == 0


def test_matrix_merges_equal_the_library(multi):
    coder = byte_bpe.byte_pairs()
    for _, text in texts(6, 300, 200):
        pieces = [p.encode() for p in byte_bpe.splitter().findall(text)]
        ids = [i for piece in coder.encode(pieces) for i in piece.tolist()]
        assert ids == multi.encode_ordinary(text)
        assert coder.decode(np.array(ids, np.int64)).tobytes() == text.encode()


def test_long_pieces_merge_in_place(multi):
    coder = byte_bpe.byte_pairs()
    for text in ("a" * 3000, "".join(random.Random(1).choice("abcdefgh") for _ in range(4000))):
        assert coder.encode([text.encode()])[0].tolist() == multi.encode_ordinary(text)


def test_round_trip_of_odd_rows(documents, no_documents, multi):
    encoded = byte_bpe.encode_texts(documents)
    decoded = byte_bpe.decode_ids(encoded, keep=("doc_id",)).collect()
    rows = encoded.collect()
    want = Counter((r["doc_id"], tuple(multi.encode_ordinary(r["text"] or ""))) for r in documents.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert Counter((r["doc_id"], hashlib.sha256(bytes(r["decoded"])).hexdigest()) for r in decoded) == Counter(
        (r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in documents.collect()
    )
    assert byte_bpe.encode_texts(no_documents).count() == 0


def test_decoding_null_lists_and_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [72, None, 73])], "doc_id long, ids array<int>")
    coder = byte_bpe.byte_pairs()
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode_ids(rows).collect()}
    assert got == {1: b"", 2: b"", 3: coder.decode(np.array([72, 73])).tobytes()}


def check_packing(packed, capacity):
    filled = {}
    for r in packed:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_pieces_and_sequences(documents, no_documents, library):
    pieces = packing.cut_documents(documents, capacity=64)
    packed = packing.pack(pieces, capacity=64, p=packing.Islands(shard_pieces=50)).collect()
    want = Counter()
    for r in documents.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, packing.END], "<u4")
        first = len(ids) % 64 or 64
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 64)], [*range(first, len(ids), 64), len(ids)], strict=True)):
            want[r["doc_id"], piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bound = -(-sum(r["length"] for r in packed) // 64)
    assert check_packing(packed, 64) <= bound + 2
    assert packing.pack(packing.cut_documents(no_documents)).count() == 0


def test_sequences_hold_their_pieces_ids(documents):
    unique = documents.filter("doc_id < 12")
    pieces = packing.cut_documents(unique, capacity=64, with_ids=True).cache()
    packed = packing.pack(pieces, capacity=64)
    ids = {(r["doc_id"], r["piece"]): r["ids"] for r in pieces.collect()}
    want = {}
    for r in sorted(packed.collect(), key=lambda r: r["offset"]):
        want.setdefault(tuple(ids[r["doc_id"], r["piece"]]), 0)
    total = [i for r in packing.sequences(packed, pieces).collect() for i in r["ids"]]
    assert Counter(total) == Counter(i for part in ids.values() for i in part)


def test_crossover_keeps_every_piece_and_the_capacity():
    random_ = np.random.default_rng(1)
    sizes = np.sort(random_.integers(1, 100, 300))[::-1].astype(np.int64)
    a, b = packing.grouping(sizes, 100), packing.grouping(sizes, 100, random_.integers(0, 30, 300))
    child = packing.crossover(a, b, sizes, 100, random_)
    assert (child >= 0).all() and np.bincount(child, sizes).max() <= 100
    best = packing.evolve(sizes, [], 100, packing.Islands(children=20), 4)
    assert packing.merit(best, sizes, 100) >= packing.merit(a, sizes, 100)


def test_islands_search_beyond_best_fit():
    p, sizes = packing.Islands(), np.sort(np.random.default_rng(1).integers(500, 1100, 4000))[::-1].astype(np.int64)
    elites = [packing.evolve(sizes, [], 2048, p, p.seed + 1000 * i) for i in range(p.islands)]
    for step in range(1, p.rounds):
        elites = [packing.evolve(sizes, [e, elites[i - 1]], 2048, p, p.seed + 1000 * i + 7919 * step) for i, e in enumerate(elites)]
    assert max(packing.merit(e, sizes, 2048)[0] for e in elites) >= packing.merit(packing.grouping(sizes, 2048), sizes, 2048)[0] + 7
