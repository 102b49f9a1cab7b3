"""Secret scans: broad candidates, and a random forest that removes the false positives.

Candidates are runs of key-like characters that hold a digit or change their case often, and whatever is assigned to a name like ``password``. The forest is trained
on labelled findings, at most about ``train_rows``, one Spark task a tree, on length, character transitions, dictionary coverage, path and
neighbouring words, and judges every candidate. The dictionary is the ``dictionary_words`` most frequent words of the whole
corpus, in any script. Forest and dictionary have a bounded size, so a scan with them needs no shuffle.

Where nobody has labelled findings, ``planted_findings`` makes them: generated secrets and look-alikes (mail addresses, dates, versions, numbers, hashes
of commits, identifiers, plain words after such names) are put between the words of a bounded sample of documents, and every candidate that covers one has its label. So the labels come from
what was planted, and not from the formats of values.
"""

from __future__ import annotations

import base64
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, drop_table, materialise, passes


@dataclass(frozen=True)
class SecretParams:
    min_length: int = 8
    swings: int = 5  # changes between capitals and other characters that stand for a digit
    train_rows: int = 20_000
    train_docs: int = 3000  # documents that findings are planted in
    plants: int = 6  # findings planted in one; up to ten times as many where documents are few
    dictionary_words: int = 20_000
    trees: int = 24
    depth: int = 12
    min_leaf: int = 3
    threshold: float = 0.5
    mask: str = "[SECRET]"
    seed: int = 29


_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=.@:~"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_EDGE = b"=.:,-/\"'"
#: Names that stand before a secret's value.
KEY_WORDS = (b"password", b"passwd", b"pwd", b"secret", b"token", b"key", b"apikey", b"api_key", b"auth", b"bearer", b"credential")
_ASSIGN = re.compile(rb"^([A-Za-z_][A-Za-z_\-]*)[=:](?=.)", re.S)
_NAMED = re.compile(rb"(?i)(?:password|passwd|pwd|secret|token|key|auth|bearer|credential)[a-z_\-]{0,20}[ \t]*[=:][ \t]*[\"']?([^\s\"',;<>()]+)")


@dataclass(frozen=True)
class Candidate:
    start: int  # bytes
    end: int
    value: bytes
    before: bytes
    after: bytes


def candidates(text: bytes, p: SecretParams) -> list[Candidate]:
    """Key-like runs with a digit or much change of case, and values assigned to a key's name; a leading ``name=`` belongs to the neighbourhood, not to the value."""
    buf = np.frombuffer(text, np.uint8)
    run = np.concatenate(([False], _RUN[buf], [False]))
    edges = np.flatnonzero(run[1:] != run[:-1])
    lo, hi = edges[0::2], edges[1::2]
    digits = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
    upper = (buf >= 65) & (buf < 91)
    swings = np.concatenate(([0, 0], np.cumsum(upper[1:] ^ upper[:-1]))) if len(buf) else np.zeros(1, np.int64)
    good = (hi - lo >= p.min_length) & ((digits[hi] > digits[lo]) | (swings[hi] - swings[np.minimum(lo + 1, len(buf))] >= p.swings))
    spans = [m.span(1) for m in _NAMED.finditer(text)]
    named = np.array([a for a, _ in spans], np.int64)
    for a, b in zip(lo[good].tolist(), hi[good].tolist(), strict=True):
        if m := _ASSIGN.match(text[a:b]):
            a += m.end()
        at = int(np.searchsorted(named, b)) - 1  # the last named value that begins before the run's end
        if at < 0 or spans[at][1] <= a:
            spans.append((a, b))
    out = []
    for a, b in sorted(spans):
        value = text[a:b]
        a += len(value) - len(value.lstrip(_EDGE))
        value = text[a:b].rstrip(_EDGE) if not text[a:b].endswith(b"==") else text[a:b]
        if len(value) >= p.min_length:
            out.append(Candidate(a, a + len(value), value, text[max(0, a - 40) : a], text[a + len(value) : a + len(value) + 40]))
    return out


def _chars(rng: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))


_HEX, _ALNUM, _UPPER = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
_NAMES = ("password", "passwd", "pwd", "secret", "client_secret", "token", "auth_token", "api_key", "apikey", "access-key", "credential")


def _assigned(rng: random.Random, value: str, names: tuple[str, ...] = _NAMES) -> tuple[str, str, str]:
    """(before, value, after) of an assignment in one of several notations."""
    name = rng.choice(names)
    name = name.upper() if rng.random() < 0.3 else name
    before, after = rng.choice((("=", ""), (" = \"", "\""), (": ", ""), ("='", "'"), (": \"", "\""), (" = ", "")))
    return name + before, value, after


def _bare(value: str) -> tuple[str, str, str]:
    return "", value, ""


#: Generators of secrets and of look-alikes: (before, value, after).
SECRETS: dict[str, Callable[[random.Random], tuple[str, str, str]]] = {
    "cloud key": lambda r: _bare(r.choice(("AKIA", "ASIA")) + _chars(r, _UPPER, 16, 16)),
    "forge token": lambda r: _bare("gh" + r.choice("pousr") + "_" + _chars(r, _ALNUM, 36, 36)),
    "prefixed key": lambda r: _bare(r.choice(("sk-", "pk_live_", "xoxb-", "glpat-")) + _chars(r, _ALNUM, 20, 48)),
    "hex token": lambda r: _assigned(r, _chars(r, _HEX, 16, 64)),
    "upper hex": lambda r: _assigned(r, _chars(r, _HEX, 16, 64).upper()),
    "random password": lambda r: _assigned(r, _chars(r, _ALNUM + "!#$%&*+-_", 8, 24)),
    "password of digits": lambda r: _assigned(r, _chars(r, string.digits + "abcdef"[: r.randint(0, 2)], 8, 20), ("password", "passwd", "pwd", "client_secret")),
    "password of letters": lambda r: _assigned(r, _chars(r, string.ascii_letters, 10, 20)),
    "base64": lambda r: _assigned(r, base64.b64encode(r.randbytes(r.randint(15, 48))).decode()),
    "web token": lambda r: _bare("eyJ" + _chars(r, _ALNUM, 20, 40) + "." + _chars(r, _ALNUM + "_-", 30, 60) + "." + _chars(r, _ALNUM + "_-", 30, 43)),
}
HARMLESS: dict[str, Callable[[random.Random, list[str]], tuple[str, str, str]]] = {
    "mail": lambda r, w: _bare(f"{r.choice(w)}.{r.randint(1, 999)}@{r.choice(w)}{r.randint(1, 99)}.example.com"),
    "date": lambda r, w: _bare(f"{r.randint(1970, 2035)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}"),
    "number": lambda r, w: _bare(str(r.randint(10**8, 10**16))),
    "phone": lambda r, w: _bare(f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}"),
    "version": lambda r, w: _bare(f"{r.choice(w)}-{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}"),
    "address": lambda r, w: _bare(f"https://{r.choice(w)}.example.org/{r.choice(w)}/{r.randint(1, 9999)}"),
    "commit": lambda r, w: (r.choice(("commit ", "revision ", "md5 ", "sha1 ", "etag ")), _chars(r, _HEX, 32, 40), ""),
    "identifier": lambda r, w: _bare("-".join(_chars(r, _HEX, n, n) for n in (8, 4, 4, 4, 12))),
    "word and digits": lambda r, w: _bare(f"{r.choice(w)}{r.choice(w)}{r.randint(1, 9999)}"),
    "file": lambda r, w: _bare(f"{r.choice(w)}/{r.choice(w)}_{r.randint(1, 999)}.{r.choice(('png', 'txt', 'csv', 'html'))}"),
    "words after a name": lambda r, w: _assigned(r, f"{r.choice(w)}{r.choice(w)}", ("key", "token", "secret", "auth", "keyword", "author")),
    "number after a name": lambda r, w: _assigned(r, str(r.randint(10**7, 10**9)), ("key", "token", "keyid", "author")),
    "place holder": lambda r, w: _assigned(r, r.choice(("${PASSWORD}", "<password>", "xxxxxxxxxx", "**********", "your_password_here", "changeme-please", "process.env.SECRET_KEY", "{{ secret }}", "REDACTED_VALUE"))),
}


def plant(text: str, p: SecretParams, seed: int) -> tuple[bytes, list[tuple[int, int, str, int]]]:
    """The text with findings put between its words, and of each (first byte, end, kind, label)."""
    rng = random.Random(seed)
    words = text.split(" ")
    plain = [w for w in words if w.isalpha() and len(w) > 2][:200] or ["word"]
    parts, marks, size = [], [], 0

    def add(x: str) -> None:
        nonlocal size
        parts.append(x.encode("utf-8", "replace"))
        size += len(parts[-1])

    spots = set(rng.sample(range(len(words) + 1), min(p.plants, len(words) + 1)))
    for i in range(len(words) + 1):
        if i in spots:
            secret = rng.random() < 0.5
            kind = rng.choice(list(SECRETS if secret else HARMLESS))
            before, value, after = SECRETS[kind](rng) if secret else HARMLESS[kind](rng, plain)
            add((" " if i else "") + before)
            begin = size
            add(value)
            marks.append((begin, size, kind, int(secret)))
            add(after + ("" if i or not words else " "))
        if i < len(words):
            add((" " if i else "") + words[i])
    return b"".join(parts), marks


_NEIGHBOURS = 16
_WORD = re.compile(r"[^\W\d_]{3,}")


def features(c: Candidate, path: str, words: frozenset[str]) -> list[float]:
    v, n = c.value, len(c.value)
    kind = ["d" if 48 <= x < 58 else "u" if 65 <= x < 91 else "l" if 97 <= x < 123 else "s" for x in v]
    moves = Counter(a + b for a, b in zip(kind, kind[1:], strict=False))
    count = Counter(v)
    entropy = -sum(k / n * np.log2(k / n) for k in count.values())
    covered = 0
    for w in _WORD.findall(v.decode("utf-8", "replace").lower()):
        at = 0
        while at < len(w):
            hit = next((k for k in range(min(20, len(w) - at), 2, -1) if w[at : at + k] in words), 0)
            covered += hit
            at += hit or 1
    left, right = re.findall(rb"[A-Za-z_]+", c.before.lower())[-2:], re.findall(rb"[A-Za-z_]+", c.after.lower())[:1]
    near = [0.0] * _NEIGHBOURS
    for w in [*left, *right]:
        near[crc32(w) % _NEIGHBOURS] += 1.0
    hexes = sum(x in b"0123456789abcdefABCDEF" for x in v)
    return [
        float(n), entropy, *(kind.count(k) / n for k in "duls"), *(moves[a + b] / max(1, n - 1) for a in "dul" for b in "dul" if a != b),
        hexes / n, covered / n, float("@" in v.decode("latin-1")), float(v.count(b".") + v.count(b"/")), float(any(k in c.before.lower() for k in KEY_WORDS)),
        float(c.before.rstrip().endswith((b"=", b":", b'"', b"'"))), float(c.after[:1] in (b'"', b"'")), float(len(path)), float(crc32(path.encode()) % 16), *near,
    ]


def grow_tree(x: np.ndarray, y: np.ndarray, chance: np.ndarray, p: SecretParams, seed: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, threshold, left, right, share of secrets) of one tree on a bootstrap sample drawn by ``chance``, split by Gini impurity."""
    rng = np.random.default_rng(seed)
    pick = rng.choice(len(y), len(y), p=chance)
    x, y = x[pick], y[pick]
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at, mean = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, -1, -1, mean))
        if depth == p.depth or len(rows) < 2 * p.min_leaf or mean in (0.0, 1.0):
            return at
        best = (mean * (1 - mean) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, ones = x[rows[order], f], np.cumsum(y[rows[order]])
            n = np.arange(1, len(rows))
            cut = np.flatnonzero((v[1:] > v[:-1]) & (n >= p.min_leaf) & (len(rows) - n >= p.min_leaf))
            if len(cut):
                k, a = n[cut], ones[cut]
                b = ones[-1] - a
                m = len(rows) - k
                g = (a * (k - a) / k + b * (m - b) / m) / len(rows)
                i = int(g.argmin())
                if g[i] < best[0]:
                    best = (float(g[i]), int(f), float(v[cut[i]] + v[cut[i] + 1]) / 2)
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            a = grow(rows[left], depth + 1)
            b = grow(rows[~left], depth + 1)
            nodes[at] = (best[1], best[2], a, b, mean)
        return at

    grow(np.arange(len(y)), 0)
    return nodes


@dataclass(frozen=True)
class SecretModel:
    params: SecretParams
    words: frozenset[str]
    trees: list[list[tuple[int, float, int, int, float]]]

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x, total = np.array(rows).reshape(len(rows), -1), np.zeros(len(rows))
        for tree in self.trees:
            feature, cut, left, right, share = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(rows), int)
            for _ in range(self.params.depth + 1):
                f = feature[at]
                low = x[np.arange(len(rows)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(low, left[at], right[at]))
            total += share[at]
        return total / max(1, len(self.trees))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()
    for batch in batches:
        for lo, hi in passes(batch.column("n").to_numpy()):
            for t in batch.column("text")[lo:hi].to_pylist():
                total.update(_WORD.findall(t.lower()))
            if len(total) > 500_000:
                yield _counted(total)
                total = Counter()
    yield _counted(total)


def _counted(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def _dictionary(docs: DataFrame, p: SecretParams) -> frozenset[str]:
    """The most frequent words. Where words tie at the bound, all of that count are left out, so the driver never gets more than the bound."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select(text.alias("text"), F.octet_length(text).alias("n")).mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(words)
    # Counts of counts, from the highest down: as many rows as there are different counts.
    counts = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(p.dictionary_words).collect()
    least, held = None, 0
    for r in counts:
        held += r["words"]
        if held > p.dictionary_words:
            break
        least = r["n"]
    found = frozenset(words.where(F.col("n") >= least).select("word").toArrow()["word"].to_pylist()) if least is not None else frozenset()
    drop_table(words)
    return found


_FINDING = "label int, features array<double>"


def _planter(words: frozenset[str], p: SecretParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, path, turn in zip(*(batch.column(c).to_pylist() for c in ("text", "path", "turn")), strict=True):
                raw, marks = plant(text or "", p, turn)
                starts = np.array([m[0] for m in marks])
                for c in candidates(raw, p):
                    at = int(np.searchsorted(starts, c.end, "left")) - 1
                    if at >= 0 and marks[at][1] > c.start:
                        rows.append((marks[at][3], features(c, path or "", words)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["label", "features"])

    return run


def planted_findings(docs: DataFrame, words: frozenset[str], p: SecretParams = SecretParams()) -> DataFrame:
    """Labelled findings (label, features) planted in at most about ``train_docs`` (twice that in any case) documents of distinct texts."""
    turn = F.xxhash64("text", F.lit(p.seed))
    total = docs.count()
    p = replace(p, plants=min(10 * p.plants, max(p.plants, p.train_docs // max(total, 1))))
    share = min(1.0, p.train_docs / max(total, 1))
    drawn = docs.withColumn("turn", turn).where(F.pmod("turn", F.lit(1 << 40)) < int(share * (1 << 40))).groupBy("turn").agg(F.first("text").alias("text"), F.first("path").alias("path"))
    return drawn.orderBy("turn").limit(2 * p.train_docs).mapInArrow(_planter(words, p), _FINDING)


def _labeller(words: frozenset[str], p: SecretParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, path, start, length, label in zip(*(batch.column(c).to_pylist() for c in ("text", "path", "start", "length", "label")), strict=True):
                a = len((text or "")[:start].encode())
                b = a + len((text or "")[start : start + length].encode())
                rows += [(label, features(c, path or "", words)) for c in candidates((text or "").encode(), p) if c.start < b and c.end > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["label", "features"])

    return run


def fit_secret_model(docs: DataFrame, p: SecretParams = SecretParams(), findings: DataFrame | None = None) -> SecretModel:
    """Dictionary and forest from ``docs(text, path)``.

    ``findings(text, path, start, length, label)`` are labelled findings (code points; 1 secret, 0 not), where there are any; else findings are
    planted. Without findings of both kinds there are no trees and nothing counts as secret. Null texts and paths are empty.
    """
    with batch_rows(docs.sparkSession):
        return _fit(docs, p, findings)


def _fit(docs: DataFrame, p: SecretParams, findings: DataFrame | None) -> SecretModel:
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("path").cast("string").alias("path"))
    words = _dictionary(docs, p)
    if findings is None:
        rows = planted_findings(docs, words, p)
    else:
        rows = findings.select(F.col("text").cast("string").alias("text"), F.col("path").cast("string").alias("path"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.col("label").cast("int").alias("label")).where("label is not null").mapInArrow(_labeller(words, p), _FINDING)
    rows = materialise(rows)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return SecretModel(p, words, [])
    # Equal findings count by their number: the sample is of distinct ones, and each comes with its weight.
    distinct = rows.groupBy("label", "features").agg(F.count("*").alias("weight"))
    # The bound makes it safe to hold the sample in the driver and to broadcast it to the trees' tasks.
    sample = distinct.withColumn("turn", F.xxhash64("features", F.lit(p.seed))).orderBy("turn", "features").limit(p.train_rows).toArrow()
    drop_table(rows)
    x, y, weight = sample["features"].combine_chunks().flatten().to_numpy().reshape(len(sample), -1), sample["label"].to_numpy(), sample["weight"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return SecretModel(p, words, [])
    held = spark.sparkContext.broadcast((x, y, weight / weight.sum()))

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, chance = held.value
        for batch in batches:
            for i in batch.column("id").to_pylist():
                nodes = grow_tree(x, y, chance, p, p.seed + i)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(nodes)), pa.array(range(len(nodes)), pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*nodes, strict=True), (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]], ["tree", "node", "f", "cut", "l", "r", "share"])

    grown: dict[int, list] = {}
    for r in spark.range(0, p.trees, 1, min(p.trees, 8)).mapInArrow(tree, "tree long, node long, f long, cut double, l long, r long, share double").collect():
        grown.setdefault(r["tree"], []).append(tuple(r)[1:])
    held.unpersist()
    return SecretModel(p, words, [[n[1:] for n in sorted(nodes)] for _, nodes in sorted(grown.items())])


def _judged(texts: list[str | None], paths: list[str | None], model: SecretModel) -> Iterator[tuple[int, str | None, list[tuple[Candidate, float]]]]:
    """(row, text, its candidates with their scores) of every row."""
    for lo, hi in passes([len(t or "") for t in texts]):
        found = [(i, c) for i in range(lo, hi) for c in candidates((texts[i] or "").encode(), model.params)]
        scores = model.score([features(c, paths[i] or "", model.words) for i, c in found]) if found else []
        own: dict[int, list] = {}
        for (i, c), s in zip(found, scores, strict=True):
            own.setdefault(i, []).append((c, float(s)))
        for i in range(lo, hi):
            yield i, texts[i], own.get(i, [])


def scan_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """Every candidate of ``docs(doc_id, text, path)``: doc_id, start and length (code points), value, score, secret.

    Null and empty texts have none; a null path is empty; a text of any length is read whole. A score at the threshold is a secret. Repeated rows report each;
    further columns are ignored, whatever their names; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, text, found in _judged(batch.column("text").to_pylist(), batch.column("path").to_pylist(), model):
                raw = text.encode() if found else b""
                at, chars = 0, 0
                for c, s in found:
                    chars += len(raw[at : c.start].decode())
                    value = c.value.decode()
                    rows.append((ids[i], chars, len(value), value, s, s >= model.params.threshold))
                    chars, at = chars + len(value), c.end
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "value", "score", "secret"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("path").cast("string").alias("path"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, value string, score double, secret boolean")


def mask_secrets(docs: DataFrame, model: SecretModel, path: str) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced by the mask; no row goes and no other column changes. Null and empty texts stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, text, found in _judged(batch.column("text").to_pylist(), batch.column(path).cast(pa.string()).to_pylist(), model):
                found = [c for c, s in found if s >= model.params.threshold]
                if found:
                    raw, at, parts = text.encode(), 0, []
                    for c in found:
                        parts += [raw[at : c.start], model.params.mask.encode()]
                        at = c.end
                    text = b"".join([*parts, raw[at:]]).decode()
                out.append(text)
            cols = [pa.array(out, batch.schema.field(n).type) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
