"""Personal data, quality rules, toxicity and languages."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import langid, pii, quality, toxicity
from panelforge.llm.frames import held_out
from panelforge.llm.words import shingle_sets, word_hashes

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, CARD, 14, 19), (3, PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(3)
    parts = ["a", "1", "25", "255", "0", "4111111111111111", ".", ".", "@", "-", " ", "+", "(", ")", "é", "_", "%"]
    for _ in range(20000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "1 " * 150_000):
        pii.base_spans(text)


def test_pii_of_odd_rows(documents, no_documents):
    model = pii.fit(documents)
    rows = pii.find_pii(documents, model=model).collect()
    assert len(rows) == documents.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[14]["n_email"], by_id[14]["n_ip"], by_id[14]["n_card"], by_id[14]["n_phone"]) == (1, 1, 1, 1)
    empty = hashlib.sha256(b"").hexdigest()
    assert by_id[5]["base_sha256"] == by_id[6]["base_sha256"] == empty and by_id[5]["spans"] == ""
    assert pii.find_pii(no_documents).count() == 0
    text = documents.filter("doc_id = 14").first()["text"]
    assert by_id[14]["base_sha256"] == hashlib.sha256(pii.written(brute_spans(text)).encode()).hexdigest()


def test_masking_keeps_columns_and_null_texts(documents):
    masked = pii.mask_pii(documents)
    assert masked.schema == documents.schema and masked.count() == documents.count()
    rows = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert rows[5] is None and "@" not in rows[14] and "[email]" in rows[14] and "[phone]" in rows[14]


def test_the_field_finds_unmarked_secrets(spark):
    draw = random.Random(8)

    def key():
        return "".join(draw.choice("0123456789abcdef") for _ in range(40))

    train = [f'some words here token = "{key()}" and more words {k} of them' for k in range(60)]
    train += [f"call +1 (555) 010-{1000 + k} or write to a{k}@b.example.org today" for k in range(60)]
    model = pii.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    found = pii.spans_of(f'other text token = "{key()}" follows', model)
    assert not found[0] and [pii.KINDS[k] for _, k, _ in found[1]] == ["secret"]
    base, every = pii.spans_of("write to z9@y.example.org now", model)
    assert base == every


def brute_segmentation(model, zone):
    """The best of all segmentations, listed one by one."""
    best, chosen = -np.inf, None

    def go(at, before, score, taken):
        nonlocal best, chosen
        if at == len(zone.tokens):
            if score > best:
                best, chosen = score, taken
            return
        outside = model.scores(zone.outside[at])[pii.OUTSIDE] + model.follows[before, pii.OUTSIDE]
        go(at + 1, pii.OUTSIDE, score + outside, taken)
        for end in range(at, len(zone.tokens)):
            for start, features in zone.segments[end]:
                if start == at:
                    for kind in range(pii.OUTSIDE):
                        go(end + 1, kind, score + model.scores(features)[kind] + model.follows[before, kind], [*taken, (at, end + 1, kind)])

    go(0, pii.OUTSIDE, 0.0, [])
    return chosen


def test_decoding_equals_listing_all_segmentations():
    random_ = np.random.default_rng(4)
    for text in ("see 12 or 3.4 b", "a@b.c 7", "x +1 55 y"):
        (zone,) = pii.zones(text)
        model = pii.SemiMarkov()
        for features in [*(f for found in zone.segments for _, f in found), *zone.outside]:
            for f in features:
                model.number.setdefault(f, len(model.number))
        model.weights = random_.normal(size=(len(model.number), pii.OUTSIDE + 1))
        model.follows = random_.normal(size=model.follows.shape)
        assert model.best(zone) == brute_segmentation(model, zone)


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in (k, k + 1, k + 2)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_of_odd_rows(documents, no_documents):
    few = documents.filter("doc_id is null or doc_id <> 12")
    rows = quality.quality_rules(few).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(map(str, ((r["doc_id"], *brute_quality(r["text"])) for r in few.collect())))
    assert sorted(map(str, ((r["doc_id"], *(r[n] for n in names)) for r in rows))) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.quality_rules(no_documents).count() == 0


def test_quality_drops_texts_far_from_every_language(spark):
    draw = random.Random(1)

    names = ["harbour", "winter", "lantern", "morning", "garden", "meadow", "silver"]

    def prose():
        return " ".join(draw.choice([draw.choice(["the", "of", "and", "to", "in"]), draw.choice(names) + draw.choice("aeiou") + draw.choice(names)]) for _ in range(200))

    rows = [(k, prose(), "en") for k in range(30)] + [(100, " ".join(f"{w}###%%%{k}" for k, w in enumerate(prose().upper().split())), "en"), (101, prose(), None)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[100] and kept[101] and sum(kept.values()) == 31


def test_quality_stays_in_the_engine(documents):
    plan = quality.text_features(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(5)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        words = [draw.choice(plain) for _ in range(draw.randint(20, 80))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(["grub", "vermin"]) + draw.choice(["", "ly", "ish", "er"]))
        rows.append((k, " ".join(words), "en"))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert sum((r["score"] >= 0.3) == (r["predicted"] == 1) for r in rows) == len(rows)
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)


def test_toxicity_keeps_few_weights(labelled):
    at, weights = toxicity.fit(*labelled)
    assert 0 < len(at) == len(weights) < 2000


def test_held_out_labels_change_nothing(labelled, spark):
    docs, labels = labelled
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a[0] == b[0]).all() and np.allclose(a[1], b[1])


def test_toxicity_of_odd_rows(documents, no_documents, labelled):
    _, labels = labelled
    odd = labels.sparkSession.createDataFrame([(1, 1, 1), (2, 1, None), (3, 0, 0), (None, 1, 1), (99, 1, 1), (4, 0, 7)], labels.schema)
    rows = toxicity.toxicity(documents, odd).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(no_documents, odd).count() == 0
    assert {r["score"] for r in toxicity.toxicity(documents, odd.limit(0)).collect()} == {0.5}


def scalar_ftrl(rows, p, weight):
    """Weights by plain FTRL-proximal, one coordinate at a time, over one shard."""
    import math

    z, n = {}, {}

    def weight_of(at):
        zi, ni = z.get(at, 0.0), n.get(at, 0.0)
        return 0.0 if abs(zi) <= p.l1 else -(zi - math.copysign(p.l1, zi)) / ((p.beta + math.sqrt(ni)) / p.alpha + p.l2)

    for _ in range(p.rounds):
        for row, label in rows:
            at = [0, *(int(f) + 1 for f in row)]
            w = {i: weight_of(i) for i in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - label) * (weight if label else 1.0)
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight_of(i) for i in z if weight_of(i)}


def test_weights_equal_scalar_ftrl(spark):
    from panelforge.llm.words import mix, word_hashes

    p = toxicity.Ftrl(bits=12, rounds=3, l1=0.4)
    text = {k: " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(8)) + (" grim" if k % 3 == 0 else "") for k in range(60)}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in text], "doc_id long, toxic int")
    at, w = toxicity.fit(docs, labels, p=p)
    used = [r["doc_id"] for r in docs.filter(~held_out()).collect()]
    used.sort(key=lambda k: (int(mix(np.array([k], np.uint64))[0]), text[k]))
    found = []
    for k in used:
        for _, hashes, offsets in word_hashes(pa.array([text[k]]), p.stems):
            found.append((toxicity.features(hashes, offsets, p)[0], int(k % 3 == 0)))
    ones = sum(y for _, y in found)
    want = scalar_ftrl(found, p, min(8.0, max(1.0, 0.5 * (len(found) - ones) / ones)))
    assert set(at.tolist()) == set(want) and np.allclose(w, [want[i] for i in at.tolist()], rtol=1e-9)


def test_training_rows_are_bounded_whatever_the_ids(spark):
    rows = [(i, f"text {i} {k % 5}") for i in (0, 1, 3, 5) for k in range(200)]
    labels = spark.createDataFrame([(0, 0), (1, 1), (3, 0), (5, 1)], "doc_id long, toxic int")
    some = toxicity.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", toxicity.Ftrl(sample=7))
    assert max(r["count"] for r in some.groupBy("y").count().collect()) <= 7


def test_names_of_the_operators_may_be_taken(spark):
    rows = [(k, "the cat of the house and more words", "en", 1, 2) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `__text` int, Text_ int")
    keep = ("doc_id", "text", "__text", "Text_")
    assert toxicity.score(docs, (np.array([0]), np.array([1.0])), keep=keep).columns == [*keep, "score"]
    assert langid.predict(docs, langid.fit(docs), keep=keep).columns == [*keep, "lang_pred", "score"]


def test_language_on_held_out_rows(spark):
    draw = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "er", "ö"], "cc": ["ção", "nh", "ei", "ra"]}
    rows = [(k, " ".join("".join(draw.choice(parts[lang]) for _ in range(3)) for _ in range(draw.randint(3, 60))), lang) for k, lang in enumerate(list(parts) * 150)]
    docs = spark.createDataFrame([*rows, (1000, rows[0][1], None)], "doc_id long, text string, lang string")
    found = langid.identify(docs).join(docs, "doc_id").filter("held_out").collect()
    assert len(found) > 60 and all(r["lang_pred"] == (r["lang"] or "aa") for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_landmarks_follow_the_whole_sample(spark):
    rows = [(k, "ab" if k % 3 else " ".join(f"{chr(97 + (k * j) % 26)}{chr(97 + (k + j * j) % 26)}o" for j in range(40)), "en") for k in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.landmarks) == len(np.unique(model.landmarks, axis=0)) == langid.Kernel().landmarks


def test_language_of_odd_rows(documents, no_documents):
    rows = {r["doc_id"]: r for r in langid.identify(documents).collect()}
    assert [rows[k]["lang_pred"] for k in (5, 6, 7, 11)] == ["und"] * 4 and rows[5]["score"] == 0
    assert langid.identify(no_documents).count() == 0
    unknown = documents.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(unknown).collect()} == {"und"}


def test_chunks_mark_the_same_grams():
    text = "".join(random.Random(1).choice("abc dé") for _ in range(5000))
    whole, cut = np.zeros(1 << 13, np.uint8), np.zeros(1 << 13, np.uint8)
    langid.mark(text, whole, 13)
    before, langid.CHUNK = langid.CHUNK, 100
    langid.mark(text, cut, 13)
    langid.CHUNK = before
    assert (whole == cut).all() and whole.any()


def test_word_hashes_follow_the_word_rule(documents, monkeypatch):
    import pyarrow as pa

    from panelforge.llm import words

    values = [r["text"] for r in documents.collect()]
    for block in (1 << 20, 64):
        monkeypatch.setattr(words, "BLOCK_BYTES", block)
        known, back = {}, {}
        for first, hashes, offsets in word_hashes(pa.array(values, pa.string())):
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                text = re.sub("[A-Z]+", lambda m: m[0].lower(), values[first + k] or "")
                plain = re.findall(r"[^\x20\x09-\x0D]+", text)
                assert len(plain) == b - a
                for word, number in zip(plain, hashes[a:b].tolist(), strict=True):
                    assert known.setdefault(word, number) == number and back.setdefault(number, word) == word
    assert [len(s) for s in shingle_sets(hashes[:0], np.array([0, 0]))] == [0]
