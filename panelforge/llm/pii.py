"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments of up to MAX_TOKENS tokens by features of the
segment (shape, digit and separator counts, checksum, neighbours), and a dynamic program
chooses boundaries and types of a zone jointly. Only tokens near a digit or an at sign can
be part of an entity, so text between such zones is plainly outside. The field is trained
by likelihood on a bounded sample, with the base spans and marked secrets as labels.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import by_slices, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
OUTSIDE = len(KINDS)

#: Documents and zones the field learns from, and passes over them.
TRAIN_DOCS = 400
TRAIN_ZONES = 300
EPOCHS = 4
MAX_TOKENS = 14
MAX_CHARS = 72
CONTEXT = 4
ZONE_TOKENS = 512

TRIGGER = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"\w+|[^\w\s]")
#: What marks a secret in the training sample.
SECRET = re.compile(r"""AKIA[0-9A-Z]{16}|(?<=password=)\w{6,}|(?<=token = ")\w{8,}""")


def luhn(digits: str) -> bool:
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = int(char) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap within a kind.

    The patterns are written so that no run of characters is scanned more than once: the
    local part of an address is found backwards from its at sign.
    """
    found = []
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            last = m.end()
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Zone:
    """Tokens near triggers; `segments[j]` are the candidate segments (i, features) ending at token j."""

    tokens: list[tuple[int, int]]
    segments: list[list[tuple[int, list[str]]]]
    outside: list[list[str]] = field(default_factory=list)


def _bucket(n: int) -> int:
    return n if n < 4 else 4 if n < 8 else 8 if n < 10 else 10 if n < 14 else 14 if n < 20 else 20


def _shape(word: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", word))


def segment_features(text: str, start: int, end: int, before: str, after: str) -> list[str]:
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    letters = sum(map(str.isalpha, span))
    shape = re.sub(r"\s+", " ", _shape(span))
    parts = span.split(".")
    mixed = "word" if letters and digits and span.isalnum() else "number" if digits and not letters else "other"
    return [
        f"shape {shape[:24]}",
        f"digits {_bucket(len(digits))}",
        f"size {min(len(span) // 4, 12)}",
        f"start {_shape(span[0])} {_shape(text[start - 1 : start]) or '^'}",
        f"end {_shape(span[-1])} {_shape(text[end : end + 1]) or '$'}",
        f"at {span.count('@')} dots {min(span.count('.'), 4)}",
        f"class {mixed} {min((len(span)) // 8, 4)} {span.isupper()}",
        f"luhn {14 <= len(digits) <= 19 and luhn(digits)} {letters > 0}",
        f"quad {len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts)}",
        f"gap {' ' in span} plus {span[0] == '+'}",
        f"before {_shape(before)[:8]} {before.lower()[:12]}",
        f"after {_shape(after)[:8]}",
    ]


def zones(text: str) -> list[Zone]:
    """Runs of tokens around triggers, with the segments that may be entities.

    A segment starts at a word, a plus sign or a bracket, ends at a word and holds a
    trigger. A run of ZONE_TOKENS tokens is a zone of its own, which bounds memory.
    """
    if not TRIGGER.search(text):
        return []
    out, run, quiet, recent = [], [], 0, []
    for m in TOKEN.finditer(text):
        token = m.span()
        if not run:
            recent.append(token)
            if TRIGGER.search(m[0]):
                run, recent, quiet = recent, [], 0
            else:
                del recent[:-CONTEXT]
            continue
        run.append(token)
        quiet = 0 if TRIGGER.search(m[0]) else quiet + 1
        if quiet == 2 * CONTEXT:
            out.append(run[:-CONTEXT])
            run, recent = [], run[-CONTEXT:]
        elif len(run) == ZONE_TOKENS:
            out.append(run)
            run, recent = [], []
    if run:
        out.append(run)
    return [_zone(text, tokens) for tokens in out]


def _zone(text: str, tokens: list[tuple[int, int]]) -> Zone:
    words = [text[a:b] for a, b in tokens]
    trigger = [bool(TRIGGER.search(w)) for w in words]
    wordy = [w[0].isalnum() for w in words]
    segments, outside = [], []
    for j, (_, end) in enumerate(tokens):
        found, seen = [], False
        if wordy[j]:
            for i in range(j, max(-1, j - MAX_TOKENS), -1):
                seen = seen or trigger[i]
                if end - tokens[i][0] > MAX_CHARS:
                    break
                if seen and (wordy[i] or words[i] in "+("):
                    before, after = words[i - 1] if i else "^", words[j + 1] if j + 1 < len(words) else "$"
                    found.append((i, segment_features(text, tokens[i][0], end, before, after)))
        segments.append(found)
        outside.append([f"out {_shape(words[j])[:8]}", f"out {trigger[j]} {_bucket(len(words[j]))}"])
    return Zone(tokens, segments, outside)


class SemiMarkov:
    """Weights of features by type, and of the type of a segment given the one before."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, OUTSIDE + 1))
        self.follows = np.zeros((OUTSIDE + 1, OUTSIDE + 1))

    def scores(self, features: list[str]) -> np.ndarray:
        known = [self.number[f] for f in features if f in self.number]
        return self.weights[known].sum(axis=0)

    def _lattice(self, zone: Zone) -> list[list[tuple[int, np.ndarray]]]:
        """For each end token the (start, score by type) of its segments; -inf where not allowed."""
        lattice = []
        for j, found in enumerate(zone.segments):
            edges = []
            for i, features in found:
                score = self.scores(features)
                score[OUTSIDE] = -np.inf
                edges.append((i, score))
            alone = np.full(OUTSIDE + 1, -np.inf)
            alone[OUTSIDE] = self.scores(zone.outside[j])[OUTSIDE]
            edges.append((j, alone))
            lattice.append(edges)
        return lattice

    def best(self, zone: Zone) -> list[tuple[int, int, int]]:
        """(first token, end token, type) of the entities of the best segmentation."""
        n = len(zone.tokens)
        value, back = np.full((n + 1, OUTSIDE + 1), -np.inf), {}
        value[0, OUTSIDE] = 0.0
        for j, edges in enumerate(self._lattice(zone)):
            for i, score in edges:
                paths = value[i][:, None] + self.follows
                came = paths.argmax(axis=0)
                total = paths[came, np.arange(OUTSIDE + 1)] + score
                for y in np.flatnonzero(total > value[j + 1]):
                    value[j + 1, y] = total[y]
                    back[j + 1, y] = (i, int(came[y]))
        out, j, y = [], n, int(value[n].argmax())
        while j > 0:
            i, before = back[j, y]
            if y != OUTSIDE:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def learn(self, examples: list[tuple[Zone, dict[tuple[int, int], int]]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-3) -> None:
        """Stochastic gradient ascent of the log-likelihood, with per-weight rates."""
        for zone, _ in examples:
            for features in [*(f for found in zone.segments for _, f in found), *zone.outside]:
                for f in features:
                    self.number.setdefault(f, len(self.number))
        self.weights = np.zeros((len(self.number), OUTSIDE + 1))
        seen, seen_follows = np.full(self.weights.shape, 1e-3), np.full(self.follows.shape, 1e-3)
        for _ in range(epochs):
            for zone, gold in examples:
                gradient, follows = self._gradient(zone, gold)
                for features, g in gradient:
                    at = [self.number[f] for f in features]
                    step = g - l2 * self.weights[at]
                    seen[at] += step * step
                    self.weights[at] += rate * step / np.sqrt(seen[at])
                seen_follows += follows * follows
                self.follows += rate * follows / np.sqrt(seen_follows)

    def _gradient(self, zone: Zone, gold: dict[tuple[int, int], int]) -> tuple[list[tuple[list[str], np.ndarray]], np.ndarray]:
        n, lattice = len(zone.tokens), self._lattice(zone)
        ahead, behind = np.full((n + 1, OUTSIDE + 1), -np.inf), np.full((n + 1, OUTSIDE + 1), -np.inf)
        ahead[0, OUTSIDE] = 0.0
        for j, edges in enumerate(lattice):
            for i, score in edges:
                into = np.logaddexp.reduce(ahead[i][:, None] + self.follows, axis=0) + score
                ahead[j + 1] = np.logaddexp(ahead[j + 1], into)
        behind[n] = 0.0
        for j in range(n - 1, -1, -1):
            for i, score in lattice[j]:
                out = np.logaddexp.reduce(self.follows + (score + behind[j + 1])[None, :], axis=1)
                behind[i] = np.logaddexp(behind[i], out)
        total = np.logaddexp.reduce(ahead[n])
        gradient, follows = [], np.zeros_like(self.follows)
        truth = np.full(n + 1, OUTSIDE)
        inner = np.zeros(n + 1, bool)
        for (i, j), y in gold.items():
            truth[j] = y
            inner[i + 1 : j] = True
        for j, edges in enumerate(lattice):
            for place, (i, score) in enumerate(edges):
                joint = np.exp(ahead[i][:, None] + self.follows + (score + behind[j + 1])[None, :] - total)
                features = zone.outside[j] if place == len(edges) - 1 else zone.segments[j][place][1]
                g = -joint.sum(axis=0)
                follows -= joint
                y = gold.get((i, j + 1), -1) if place < len(edges) - 1 else OUTSIDE if not inner[j + 1] and (truth[j + 1] == OUTSIDE) else -1
                if y >= 0:
                    g[y] += 1.0
                    follows[truth[i], y] += 1.0
                gradient.append((features, g))
        return gradient, follows


def _examples(texts_: list[str]) -> list[tuple[Zone, dict[tuple[int, int], int]]]:
    """Zones whose labelled spans fall on candidate segments."""
    out: list[tuple[Zone, dict[tuple[int, int], int]]] = []
    for text in texts_:
        spans = [(a, b, k) for a, k, b in base_spans(text)]
        taken = [s[:2] for s in spans]
        spans += [(m.start(), m.end(), 4) for m in SECRET.finditer(text) if all(m.end() <= a or b <= m.start() for a, b in taken)]
        for zone in zones(text):
            starts, ends = {a: i for i, (a, _) in enumerate(zone.tokens)}, {b: i for i, (_, b) in enumerate(zone.tokens)}
            gold, last, fits = {}, -1, True
            for a, b, kind in sorted(s for s in spans if s[0] < zone.tokens[-1][1] and s[1] > zone.tokens[0][0]):
                i, j = starts.get(a), ends.get(b)
                fits = fits and i is not None and j is not None and i > last and any(i == x for x, _ in zone.segments[j])
                if not fits:
                    break
                gold[i, j + 1], last = kind, j
            if fits and len(zone.tokens) <= 200:
                out.append((zone, gold))
    return out


def fit(df: DataFrame, text: str = "text", docs: int = TRAIN_DOCS, most_zones: int = TRAIN_ZONES) -> SemiMarkov:
    """A field learned from at most `docs` texts with a digit or an at sign, of at most 20,000 characters."""
    rows = df.select(F.col(text).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= 20000))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # the bound is found on hashes alone, so that no other text comes to the driver
    bound = rows.select("hash").distinct().orderBy("hash").limit(docs).agg(F.max("hash")).first()[0]
    found = rows.filter(F.col("hash") <= bound).groupBy("hash").agg(F.min("text").alias("text")).collect() if bound is not None else []
    chosen = [r["text"] for r in sorted(found, key=lambda r: r["hash"])]
    examples = _examples(chosen)
    labelled, plain = [e for e in examples if e[1]], [e for e in examples if not e[1]]
    model = SemiMarkov()
    model.learn([*labelled[: most_zones - most_zones // 4], *plain[: most_zones // 4]])
    return model


def spans_of(text: str, model: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the field's are added where they meet no base span."""
    base = base_spans(text)
    every = list(base)
    for zone in zones(text):
        for i, j, kind in model.best(zone):
            start, end = zone.tokens[i][0], zone.tokens[j - 1][1]
            if all(end <= a or b <= start for a, _, b in base):
                every.append((start, kind, end))
    return base, sorted(every)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Offsets are code points, ends exclusive; counts and the digest are those of the base
    spans. Null texts count as empty: no spans and the digest of nothing. Rows are searched
    one by one, so repeated rows and null keys stay. Without a row to learn from, the
    field adds nothing.
    """
    model = model or fit(df, text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, listed = [[] for _ in BASE_KINDS], [], []
        for value in batch.column("text").to_pylist():
            base, every = spans_of(value or "", model)
            for kind, column in enumerate(counts):
                column.append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            listed.append(written(every))
        columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return texts(df, key, text).mapInArrow(by_slices(work), schema)


def mask_pii(df: DataFrame, text: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """The rows and columns of `df` with all found spans of `text` masked; null texts stay null."""
    model = model or fit(df, text)
    at = df.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else masked(t, spans_of(t, model)[1]) for t in batch.column(at).to_pylist()]
        columns = batch.columns
        columns[at] = pa.array(new, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(by_slices(work), df.schema)
