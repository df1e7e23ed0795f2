"""Secrets in texts: three patterns, and a character convolutional network for what they miss.

Candidates are what the patterns match, and runs of 12 or more token characters
less that. The network reads each with its surroundings, in windows of 64 characters
over the whole candidate: an embedding by convolution (five characters wide),
a rectifier, maximum and mean over positions, and a logistic unit, all in numpy.
Its filters are learned from generated findings alone: tokens of public formats and
harmless look-alikes in made-up surroundings. The logistic unit, its calibration and
the threshold are fitted to these and to every document: all that the patterns find, all
other candidates that are harmless by their form (``HARMLESS``), and one generated
finding planted in each. All others are unlabelled and left out, as the secrets to be
found are among them. Newton's method takes sums over all windows in each pass;
Platt scaling and the threshold, the highest that keeps the demanded recall, come from
counts of the margins of all windows of a validation part.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cipherlake.functions.storage import materialise
from cipherlake.llm.common import strings

#: Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Characters of a candidate at least.
LEAST = 12
SPACE = re.compile(r"\s")
#: Harmless by form: words and what parts them, groups of few digits (dates, numbers, addresses), one character repeated.
HARMLESS = re.compile(r"(?!.*[A-Za-z][A-Z])[A-Za-z+/_.=-]+|[+/_.=-]*\d{1,4}(?:[+/_.=-]+\d{1,4})+[+/_.=-]*|(.)\1+")
KINDS = ("assign", "access", "hex", "network")
#: An assignment holds one of these, whatever its case.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
WINDOW, STRIDE, BEFORE, AFTER, WIDTH, FILTERS = 64, 32, 16, 8, 5, 24
_ALPHABET = string.ascii_letters + string.digits + "+/_.=-:\"' \n,;@#()[]{}<>!?*&%$\\|~^`"
_CODE = np.full(128, 1, np.uint8)  # 0 pads, 1 is any other ASCII, 2 any other character
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(3, 3 + len(_ALPHABET))
CODES = 3 + len(_ALPHABET)
#: Steps of a margin of 1 by which margins are counted, the largest margin told apart, and windows whose features are held at a time.
STEPS, LARGEST, HELD = 1024, 60, 4096
#: Weight of the squared coefficients of the logistic unit, digits it is rounded to, and its passes at most.
RIDGE, DIGITS, PASSES = 1e-4, 6, 40


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, ``kind`` an index of ``KINDS``, in order."""
    low = text.lower()
    out = []
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for run in RUN.finditer(text):  # what the other two match lies inside a run
        a, b = run.span()
        if b - a >= 16:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 18]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [run.span() for run in RUN.finditer(text)]


def pieces(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What is left of the candidates without the spans of ``taken`` (by start), where it is long enough; one pass over both."""
    out, k = [], 0
    for a, b in candidates(text):
        while k < len(taken) and taken[k][0] < b:
            s, _, e = taken[k]
            if s - a >= LEAST:
                out.append((a, s))
            a = max(a, e)
            if e > b:  # it reaches into the next candidate
                break
            k += 1
        if b - a >= LEAST:
            out.append((a, b))
    return out


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 2).astype(np.uint8)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Codes of the windows that cover the candidate and its surroundings."""
    a = max(0, start - BEFORE)
    codes = encode(text[a : end + AFTER])
    lead = BEFORE - (start - a)
    codes = np.concatenate([np.zeros(lead, np.uint8), codes])
    out = []
    for i in range(0, max(1, len(codes) - WINDOW + STRIDE), STRIDE):
        w = codes[i : i + WINDOW]
        out.append(np.concatenate([w, np.zeros(WINDOW - len(w), np.uint8)]))
    return out


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.25, (WIDTH, CODES, FILTERS))
        self.kernel[:, 0] = 0
        self.bias = np.zeros(FILTERS)
        self.dense = rng.normal(0, 0.2, 2 * FILTERS)
        self.start = np.zeros(1)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x):
        n, places = len(x), WINDOW - WIDTH + 1
        z = np.broadcast_to(self.bias, (n, places, FILTERS)).copy()
        for k in range(WIDTH):
            z += self.kernel[k][x[:, k : k + places]]
        r = np.maximum(z, 0)
        pooled = np.concatenate([r.max(1), r.mean(1)], 1)
        return r, pooled, pooled @ self.dense + self.start

    def margin(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 512])[2] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def fit(self, x, y, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 6) -> None:
        """Adam on the logistic loss, classes weighed alike."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        params = [self.kernel, self.bias, self.dense, self.start]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                r, pooled, out = self._forward(x[at])
                d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[at]) * weight[at] / len(at)
                grad_pooled = d[:, None] * self.dense
                top, mean = grad_pooled[:, :FILTERS], grad_pooled[:, FILTERS:]
                dz = np.repeat(mean[:, None] / r.shape[1], r.shape[1], 1)
                rows, cols = np.indices(top.shape)
                dz[rows, r.argmax(1), cols] += top
                dz *= r > 0
                dk = np.zeros_like(self.kernel)
                flat = dz.reshape(-1, FILTERS)
                for k in range(WIDTH):
                    codes = x[at, k : k + r.shape[1]].ravel()
                    hot = np.zeros((len(codes), CODES), np.float32)
                    hot[np.arange(len(codes)), codes] = 1
                    dk[k] = hot.T @ flat
                dk[:, 0] = 0
                step += 1
                for p, g, a, b in zip(params, [dk, dz.sum((0, 1)), pooled.T @ d, d.sum(keepdims=True)], m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """What the logistic unit reads, and a 1."""
        parts = [self._forward(x[i : i + 512])[1] for i in range(0, len(x), 512)]
        return np.concatenate([np.concatenate(parts), np.ones((len(x), 1))], 1).astype(np.float32) if parts else np.zeros((0, 2 * FILTERS + 1), np.float32)

    def calibrate(self, x, y, recall: float) -> None:
        """``settle`` on the margins of windows."""
        self.settle(counted(self.margin(x), np.asarray(y)), recall)

    def settle(self, counts: dict[tuple[int, int], int], recall: float) -> None:
        """Platt scaling, and the highest threshold with ``recall`` of the positives, from counts by (label, margin in ``STEPS`` of 1)."""
        keys = sorted(counts)
        y, s = np.array([k[0] for k in keys], float), np.array([k[1] for k in keys]) / STEPS
        n = np.array([counts[k] for k in keys], float)
        design = np.stack([s, np.ones_like(s)], 1)
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            h = (design * (n * p * (1 - p))[:, None]).T @ design / n.sum() + 1e-4 * np.eye(2)
            w -= np.linalg.solve(h, design.T @ (n * (p - y)) / n.sum() + 1e-4 * w)
        self.scale, self.shift = float(w[0]), float(w[1])
        good, many = self.score(s[y == 1]), n[y == 1]
        order = np.argsort(good, kind="stable")
        # the score of the positive at this place of their order
        at = int((1 - recall) * many.sum())
        self.threshold = float(good[order][np.searchsorted(np.cumsum(many[order]), at, "right")]) if len(good) else 1.0

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))

    def passes(self, text: str, found: list[tuple[int, int]]) -> list[bool]:
        """Which of the spans ``found`` have a window that passes the threshold."""
        out = []
        for i in range(0, len(found), 256):
            parts = [windows(text, a, b) for a, b in found[i : i + 256]]
            s = self.score(self.margin(np.array([w for p in parts for w in p])))
            first = np.cumsum([0] + [len(p) for p in parts])
            out += (np.maximum.reduceat(s, first[:-1]) >= self.threshold).tolist()
        return out

    def spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates, less the spans of ``taken``, that pass the threshold."""
        free = pieces(text, taken)
        return [(a, 3, b) for (a, b), good in zip(free, self.passes(text, free)) if good]


def labelled_findings(n: int, seed: int = 4, surroundings: list[tuple[str, str]] | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of ``n`` generated findings, half of them secrets; between ``surroundings`` (before, after) where given."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(np.array(list(chars))[rng.integers(0, len(chars), k)])
    word = lambda: pick(string.ascii_lowercase, int(rng.integers(2, 9)))
    some = lambda *xs: xs[int(rng.integers(len(xs)))]
    b62 = string.ascii_letters + string.digits

    def secret():
        return some(
            lambda: pick("0123456789abcdef", int(some(24, 32, 40, 64))),
            lambda: pick(b62 + "+/", int(rng.integers(24, 64))) + some("", "=", "=="),
            lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 16),
            lambda: "ghp_" + pick(b62, 36),
            lambda: some("sk", "pk", "rk") + some("_live_", "_test_", "-") + pick(b62, int(rng.integers(20, 40))),
            lambda: "xox" + some("b-", "p-") + pick(string.digits, 11) + "-" + pick(b62, 24),
            lambda: "eyJ" + pick(b62, 17) + ".eyJ" + pick(b62 + "_-", 30) + "." + pick(b62 + "_-", 40),
            lambda: "AIza" + pick(b62 + "_-", 35),
            lambda: pick(b62, int(rng.integers(16, 33))),
        )()

    def harmless():
        return some(
            lambda: ".".join(word() for _ in range(3)) + pick(string.digits, int(rng.integers(1, 3))) + some(".com", ".org", ".net"),
            lambda: "//www." + word() + "." + word() + some(".com/", ".org/") + word() + "/" + pick(string.digits, int(rng.integers(1, 6))),
            lambda: "/".join(word() for _ in range(4)) + some(".py", ".html", ".1", "_v2"),
            lambda: "-".join(pick(string.digits, int(k)) for k in (3, 3, 4)) + some("", "-" + pick(string.digits, 2)),
            lambda: f"20{pick(string.digits, 2)}-0{pick('123456789', 1)}-1{pick(string.digits, 1)}T{pick('01', 1)}{pick(string.digits, 1)}",
            lambda: "".join(word().title() for _ in range(4)),
            lambda: "_".join(word() for _ in range(4)) + pick(string.digits, 1),
            lambda: pick(string.digits, 3) + "." + pick(string.digits, 3) + "." + pick(string.digits, 3) + "." + pick(string.digits, 2),
            lambda: some("=", "-", ".", "_") * int(rng.integers(10, 30)) + pick(string.digits, 2),
            lambda: word() + "-" + word() + "-" + word() + "-v" + pick(string.digits, 1) + "." + pick(string.digits, 1),
            lambda: word().title() + "." + word().title() + "." + word() + pick(string.digits, 2),
        )()

    out = []
    for i in range(n):
        label = i % 2
        token = secret() if label else harmless()
        lead = " ".join(word() for _ in range(int(rng.integers(0, 5))))
        lead += some(" ", "\n", ": ", " = ", ' "', "=", " key: ", " auth ") if label else some(" ", "\n", ": ", " (", " see ", " https:", " ")
        tail = some("", " ", "\n", '"', ".") + word()
        if surroundings:
            before, after = surroundings[int(rng.integers(len(surroundings)))]
            lead, tail = before + some(" ", "\n", " "), some(" ", "\n", ". ") + after
        if len(token) >= LEAST:
            out.append((lead + token + tail, len(lead), len(lead) + len(token), label))
    return out


def letter_findings(n: int, seed: int = 9) -> list[tuple[str, int, int, int]]:
    """``n`` harmless runs of letters alone, every second one in capitals, as ``labelled_findings`` has them."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lead, token, tail = ("".join(np.array(list(string.ascii_lowercase))[rng.integers(0, 26, int(k))]) for k in (rng.integers(2, 9), rng.integers(12, 22), rng.integers(2, 9)))
        if i % 2:
            lead, token, tail = lead.upper(), token.upper(), tail.upper()
        out.append((f"{lead} {token} {tail}", len(lead) + 1, len(lead) + 1 + len(token), 0))
    return out


def counted(margins: np.ndarray, labels: np.ndarray) -> dict[tuple[int, int], int]:
    """Counts by (label, margin rounded down to 1 / ``STEPS``)."""
    bins = np.floor(np.clip(margins, -LARGEST, LARGEST) * STEPS).astype(int)
    found, n = np.unique(np.stack([labels.astype(int), bins]), axis=1, return_counts=True)
    return {(int(y), int(k)): int(c) for (y, k), c in zip(found.T, n)}


def _validates(key: str) -> bool:
    """Whether a finding is of the validation part, by what it says."""
    return hashlib.md5(key.encode("utf-8", "surrogatepass")).digest()[0] % 4 == 0


def corpus_findings(text: str, tokens: list[tuple[str, int]]) -> list[tuple[str, int, int, int, bool]]:
    """(text, start, end, label, validates) of a document: 1 what the patterns match, 0 other candidates that are ``HARMLESS``,
    and one of ``tokens (token, label)`` planted at a place between words; candidates that are neither have no label and do not come."""
    spans = base_spans(text)
    out = []
    for a, b, y in [(a, b, 1) for a, _, b in spans] + [(a, b, 0) for a, b in pieces(text, spans) if HARMLESS.fullmatch(text[a:b])]:
        s = max(0, a - BEFORE)
        near = text[s : b + AFTER]
        out.append((near, a - s, b - s, y, _validates(f"{near}:{a - s}")))
    if tokens and text:
        mark = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
        at, which, how = (int.from_bytes(mark[i : i + 4], "little") for i in (0, 4, 8))
        if m := SPACE.search(text, at % len(text)) or SPACE.search(text):
            token, y = tokens[which % len(tokens)]
            before = text[max(0, m.end() - BEFORE) : m.end()] + " \n"[how % 2]
            out.append((before + token + (" ", "\n", ". ")[how // 2 % 3] + text[m.end() : m.end() + AFTER], len(before), len(before) + len(token), y, _validates(token)))
    return out


def corpus_features(docs: DataFrame, net: Network, tokens: list[tuple[str, int]]) -> DataFrame:
    """(y, validates, f) of every window of the labelled findings of all ``docs``: what the logistic unit reads, as float32."""
    known = docs.sparkSession.sparkContext.broadcast((net, tokens))

    def made(rows):
        f = known.value[0].pooled(np.array([w for w, _, _ in rows]))
        return pa.RecordBatch.from_arrays([pa.array([y for _, y, _ in rows], pa.int32()), pa.array([v for _, _, v in rows], pa.bool_()), pa.array([r.tobytes() for r in f], pa.binary())], ["y", "validates", "f"])

    def run(batches):
        rows = []
        for batch in batches:
            for text in strings(batch.column(0)):
                for t, a, b, y, v in corpus_findings(text or "", known.value[1]):
                    for w in windows(t, a, b):
                        rows.append((w, y, v))
                        if len(rows) == HELD:
                            yield made(rows)
                            rows = []
        if rows:
            yield made(rows)

    return materialise(docs.select("text").mapInArrow(run, "y int, validates boolean, f binary"), "features")


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(len(batch), -1).astype(float)


def _sums(f: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic loss, its gradient and its second derivatives, row after row; labels weigh ``weight[label]``."""
    z = np.clip(f @ w, -LARGEST, LARGEST)
    p, each = 1 / (1 + np.exp(-z)), weight[y]
    loss = (each * (np.logaddexp(0, z) - y * z)).sum()
    return np.concatenate([[loss], f.T @ (each * (p - y)), ((f * (each * p * (1 - p))[:, None]).T @ f).ravel()])


def fit_unit(features: DataFrame, own: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> np.ndarray:
    """The logistic unit of all rows of ``features (y, f)`` and ``own``, classes weighed alike, by Newton's method.

    Each pass sums over all rows where they are. Results are rounded, so that the
    order of sums does not show.
    """
    f, y = own
    counts = np.bincount(y, minlength=2) + np.array([features.where(F.col("y") == k).count() for k in (0, 1)])
    weight, size = 0.5 / np.maximum(counts, 1), len(start)

    def sums(w):
        def run(batches):
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                total += _sums(_features(batch), batch.column(0).to_numpy(), w, weight)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "x"])

        found = _sums(f, y, w, weight)
        for at, x in features.select("y", "f").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
            found[at] += x
        loss, g, h = found[0], found[1 : 1 + size], found[1 + size :].reshape(size, size)
        return loss + RIDGE / 2 * w @ w, g + RIDGE * w, h + RIDGE * np.eye(size)

    w = np.array(start, float)
    loss, g, h = sums(w)
    step = -np.linalg.solve(h, g)
    for _ in range(PASSES):
        if np.abs(step).max() < 0.1 ** (DIGITS + 2):
            break
        new = sums(w + step)
        if new[0] > loss:
            step = step / 4
            continue
        w, (loss, g, h) = w + step, new
        step = -np.linalg.solve(h, g)
    return np.round(w, DIGITS)


def train(docs: DataFrame, generated: int = 4000, recall: float = 0.97) -> Network:
    """A network: filters from ``generated`` findings, the rest from these and the labelled findings of all ``docs``; all windows of each."""
    rows = [(*r, _validates(r[0][r[1] : r[2]])) for r in labelled_findings(generated) + letter_findings(generated // 8)]
    parts = [windows(t, a, b) for t, a, b, _, _ in rows]
    sizes = [len(p) for p in parts]
    x, y = np.array([w for p in parts for w in p]), np.repeat([r[3] for r in rows], sizes)
    late = np.repeat([r[4] for r in rows], sizes)
    net = Network()
    net.fit(x[~late], y[~late].astype(float))
    tokens = [(t[a:b], k) for t, a, b, k in labelled_findings(generated, 14)]
    features = corpus_features(docs, net, tokens)
    f = net.pooled(x).astype(float)
    w = fit_unit(features.where("not validates"), (f[~late], y[~late]), np.concatenate([net.dense, net.start]))
    net.dense, net.start = w[:-1], w[-1:]

    def run(batches):
        for batch in batches:
            found = counted(_features(batch) @ w, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int32()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())], ["y", "bin", "n"])

    counts = counted(f[late] @ w, y[late])
    for k, at, n in features.where("validates").select("y", "f").mapInArrow(run, "y int, bin int, n long").groupBy("y", "bin").agg(F.sum("n")).collect():
        counts[k, at] = counts.get((k, at), 0) + n
    net.settle(counts, recall)
    return net


def scan(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed.

    ``spans`` are ``kind:start:end`` in code points, by start and kind, joined by
    commas; the network's carry the kind ``network`` and overlap no other.
    ``n_confirmed`` counts the patterns' spans that pass the network too; all stay. A null
    text is an empty one. Other columns are not read.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, **how))

    def joined(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches):
        for batch in batches:
            rows = []
            for text in strings(batch.column(1)):
                text = text or ""
                base = base_spans(text)
                rows.append((*[sum(k == i for _, k, _ in base) for i in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + net.value.spans(text, base))), sum(net.value.passes(text, [(a, b) for a, _, b in base]))))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
