"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

One pass over the whole texts finds the pattern spans (``assign``, ``access``, ``hex``) and every candidate: a run
of LONG or more key characters, single dots between them included, or of SHORT or more (as few as ``assign`` takes) within
NEAR characters of a key word; letters or digits alone will do. The network reads a candidate, whole, with CONTEXT characters on
either side. It is trained on labelled findings: candidates that a pattern span touches are secrets, the others
are not; at most SAMPLE_ROWS distinct ones of either label, those of the smallest hashes, and MADE random
keys set into contexts of the others, so that formats without a pattern are learnt too. A Spark pass then scores all findings
that were not trained on; these and the made keys held back calibrate the logits (Platt) and set the threshold:
the highest that still finds RECALL of the secrets among either.
Candidates at or over it that do not lie wholly in pattern spans are spans of kind ``net``.

Null and empty texts have no spans; every row is scanned for itself, repeated or not.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import hash_sample, place, plain, raw_text, stored, table

SAMPLE_ROWS, MADE, RECALL, CONTEXT = 4_000, 1_200, 0.97, 16
LONG, SHORT, NEAR = 16, 8, 24
#: Longer findings are scored like any other but not trained on.
TRAIN_CHARS = 512
KINDS = ("assign", "access", "hex", "net")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEY_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN = re.compile(rb"[A-Za-z0-9+/_=.-]{%d,}" % LONG)
_LONG, _SHORT = (re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % n) for n in (LONG, SHORT))
_PART, _ALNUM = re.compile(r"[^.]+(?:\.[^.]+)*"), re.compile(r"[A-Za-z0-9]")
#: Words that keys stand near, and what each of them holds in lower-case bytes.
_NEAR_WORD = re.compile(r"passw(?:or)?[dt]|passphrase|passcode|pwd|secret|token|credential|bearer|auth|kennwort|contrase|mot de passe|\bclave\b|(?:api|access|private)[_ -]?key|\bkeys?\b", re.ASCII | re.IGNORECASE)
_NEAR_BYTES = (b"pass", b"pwd", b"secret", b"token", b"credential", b"bearer", b"auth", b"kennwort", b"contrase", b"clave", b"key")


def pattern_spans(raw: bytes, text: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every pattern match in code points, sorted. Runs that are too short fail wherever they start, so they need no match of their own; short assignments do use up their text."""
    found = []
    low = raw.lower()
    text = raw.decode("utf-8", "replace") if text is None else text
    if any(w in low for w in _KEY_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def key_runs(text: str, near: bool = True) -> list[tuple[int, int]]:
    """(start, end) of every candidate; with ``near`` false the text has no key word."""
    words = [m.span() for m in _NEAR_WORD.finditer(text)] if near else []
    starts, found = [s for s, _ in words], []
    for m in (_SHORT if words else _LONG).finditer(text):
        for part in _PART.finditer(m[0]):
            s, e = m.start() + part.start(), m.start() + part.end()
            if e - s < SHORT or not _ALNUM.search(part[0]):
                continue
            if e - s < LONG:  # words are in order and apart, so only the last one before the run's end and the first after it can be nearest
                k = bisect_left(starts, e)
                around = [words[i] for i in (k - 2, k - 1, k) if 0 <= i < len(words) and not (words[i][0] <= s and e <= words[i][1])]
                if not any(a - e <= NEAR and s - b <= NEAR for a, b in around):
                    continue
            found.append((s, e))
    return found


def scan(raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bool, bool]], str]:
    """Pattern spans, candidates as (start, end, touched by a pattern span, wholly in pattern spans), and the text. Every pattern but a short assignment holds a run, so texts without one are cheap."""
    low = raw.lower()
    near = any(w in low for w in _NEAR_BYTES)
    if not near and not _RUN.search(raw):
        return [], [], ""
    text = raw.decode("utf-8", "replace")
    spans, runs = pattern_spans(raw, text), []
    first, far = 0, [0]
    for _, _, e in spans:
        far.append(max(far[-1], e))
    for start, end in key_runs(text, near):
        while first < len(spans) and far[first + 1] <= start:
            first += 1
        at, k, touched = start, first, False
        while k < len(spans) and spans[k][0] < end:
            s, _, e = spans[k]
            touched |= e > start
            if s <= at:
                at = max(at, e)
            k += 1
        runs.append((start, end, touched, at >= end))
    return spans, runs, text


def window(text: str, start: int, end: int) -> str:
    """Left context, candidate and right context, apart by unit separators."""
    return "\x1f".join((text[max(0, start - CONTEXT) : start].replace("\x1f", " "), text[start:end], text[end : end + CONTEXT].replace("\x1f", " ")))


FINDINGS = "n_assign bigint, n_access bigint, n_hex bigint, base string, candidates array<struct<start:bigint,stop:bigint,covered:boolean,whole:boolean,view:string>>"


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, pattern counts, pattern spans and candidates of every row."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.bool_()), ("whole", pa.bool_()), ("view", pa.string())]))
        for batch in batches:
            counts, base, found = [[], [], []], [], []
            for raw in raw_text(batch):
                spans, runs, text = scan(raw)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                base.append(joined(spans))
                found.append([{"start": s, "stop": e, "covered": c, "whole": w, "view": window(text, s, e)} for s, e, c, w in runs])
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base", "candidates"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FINDINGS}")


#: Character classes: 0 padding, then each ASCII character, then all others; and the same once more inside the candidate.
_CODES, _DIM, _FILTERS, _SPAN = 130, 12, 32, 5


def _encode(views: list[str]) -> np.ndarray:
    rows = []
    for v in views:
        left, run, right = v.split("\x1f")
        rows.append([1 + min(ord(c), 128) for c in left] + [_CODES + 1 + min(ord(c), 128) for c in run] + [1 + min(ord(c), 128) for c in right])
    width = max(map(len, rows)) + _SPAN - 1
    out = np.zeros((len(rows), width), np.int32)
    for i, r in enumerate(rows):
        out[i, _SPAN // 2 : _SPAN // 2 + len(r)] = r
    return out


@dataclass(frozen=True)
class Network:
    """Embedding, one convolution with ReLU, maximum and mean over positions, a dense output; then the calibration and the threshold."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def logits(self, views: list[str]) -> np.ndarray:
        """What the network says before the calibration."""
        out = np.zeros(len(views))
        order = np.argsort([len(v) for v in views], kind="stable")
        lo = 0
        while lo < len(order):  # neighbours in length share a batch; a long candidate makes its batch short
            hi = lo + 1
            while hi < len(order) and hi - lo < 512 and (hi - lo + 1) * len(views[order[hi]]) < 200_000:
                hi += 1
            codes = _encode([views[i] for i in order[lo:hi]])
            peak, total, size = 0.0, 0.0, 0
            for at in range(0, codes.shape[1] - _SPAN + 1, 8192):  # maximum and sum of a very long candidate, piece by piece
                z, real = _convolved(self.weights, codes[:, at : at + 8192 + _SPAN - 1])[1:]
                peak, total, size = np.maximum(peak, z.max(1)), total + z.sum(1), size + real.sum(1)
            out[order[lo:hi]] = np.concatenate([peak, total / size], 1) @ self.weights["out"] + self.weights["base"][0]
            lo = hi
        return out

    def probability(self, views: list[str]) -> np.ndarray:
        return self.calibrated(self.logits(views))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def _convolved(w: dict[str, np.ndarray], codes: np.ndarray):
    e = w["embed"][codes]
    n, wide, d = e.shape
    view = np.lib.stride_tricks.sliding_window_view(e, _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n, wide - _SPAN + 1, _SPAN * d)
    real = (codes[:, _SPAN // 2 : wide - _SPAN // 2] > 0)[:, :, None]
    return view, np.maximum(view @ w["conv"] + w["bias"], 0) * real, real


def _forward(w: dict[str, np.ndarray], codes: np.ndarray):
    view, z, real = _convolved(w, codes)
    peak, size = z.argmax(1), real.sum(1)
    pooled = np.concatenate([np.take_along_axis(z, peak[:, None], 1)[:, 0], z.sum(1) / size], 1)
    return pooled @ w["out"] + w["base"][0], (codes, view, z, real, peak, size, pooled)


def _backward(w, cache, d_logit):
    codes, view, z, real, peak, size, pooled = cache
    grad = {"out": pooled.T @ d_logit, "base": np.array([d_logit.sum()])}
    d_pool = d_logit[:, None] * w["out"][None]
    dz = np.repeat((d_pool[:, _FILTERS:] / size)[:, None], z.shape[1], 1)
    np.put_along_axis(dz, peak[:, None], np.take_along_axis(dz, peak[:, None], 1) + d_pool[:, None, :_FILTERS], 1)
    dz *= (z > 0) & real
    flat = dz.reshape(-1, _FILTERS)
    grad["conv"], grad["bias"] = view.reshape(len(flat), -1).T @ flat, flat.sum(0)
    de = (dz @ w["conv"].T).reshape(*dz.shape[:2], _SPAN, _DIM)
    grad["embed"] = np.zeros_like(w["embed"])
    for k in range(_SPAN):
        np.add.at(grad["embed"], codes[:, k : k + dz.shape[1]].ravel(), de[:, :, k].reshape(-1, _DIM))
    grad["embed"][0] = 0
    return grad


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LEADS = ("the password is ", "my token ", "secret key: ", "login with key ", "passwd ", "pwd: ", "credentials ")


def _set(key: str, contexts: list[str], i: int, else_left: str) -> str:
    """A run in one of the contexts; one under LONG stands after a key word."""
    left, _, right = contexts[i % len(contexts)].split("\x1f") if contexts else (else_left, "", " ")
    return "\x1f".join((_LEADS[i % len(_LEADS)][-CONTEXT:] if len(key) < LONG else left, key, right))


def _made(rng, contexts: list[str]) -> list[str]:
    """Random keys of common alphabets and lengths in the given contexts: with letters and digits, with letters only, and in parts joined by dots."""
    mixed = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + _DIGITS, _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "_-")
    alphabets = (*mixed, _UPPER, _LOWER, _UPPER + _LOWER)
    out = []
    for i in range(MADE):
        letters = alphabets[i % len(alphabets)]
        key = "".join(letters[j] for j in rng.integers(0, len(letters), int(rng.integers(SHORT, LONG) if i % 4 == 3 else rng.integers(18, 65))))
        if i % 8 == 4:
            cut = len(key) // 3
            key = ".".join((key[:cut], key[cut : 2 * cut], key[2 * cut :]))
        out.append(_set(key + "7" * (letters in mixed), contexts, i, "key "))
    return out


def _plain(rng, contexts: list[str]) -> list[str]:
    """Runs that are no keys: words joined to years, numbers and one another, and words by themselves near key words."""
    parts = ("report", "version", "page", "chapter", "item", "figure", "station", "section", "number", "release")
    single = ("chapters", "versions", "stations", "sections", "releases", "gardening", "manager", "published", "everything", "remember", "department", "different")
    out = []
    for i in range(MADE):
        n = int(rng.integers(2, 5))
        words = [parts[j] for j in rng.integers(0, len(parts), n)]
        if i % 6 == 5:
            run = single[int(rng.integers(0, len(single)))].ljust(SHORT, "s")
        elif i % 6 == 4:
            run = ("-", "_", "/", ".", "")[i % 5].join([*words, "of-print" * (sum(map(len, words)) < LONG)]).strip("-_/.")
        else:
            run = "_-/"[i % 3].join([*words, str(int(rng.integers(1, 3000)))])
            run += "-of-print" * (len(run) < LONG)
        out.append(_set(run, contexts, i, "the "))
    return out


def fit(views: list[str], secret: np.ndarray, epochs: int = 6, seed: int = 7) -> Network:
    """Train, calibrate and set the threshold."""
    rng = np.random.default_rng(seed)
    contexts = [v for v, s in zip(views, secret) if not s] or list(views)
    made, plain = _made(rng, contexts), _plain(rng, contexts)
    views = [*views, *made, *plain]
    y = np.concatenate([secret.astype(float), np.ones(len(made)), np.zeros(len(plain))])
    held = np.array([_digest(v)[0] % 5 == 0 for v in views])
    w = {
        "embed": rng.normal(0, 0.3, (2 * _CODES + 2, _DIM)),
        "conv": rng.normal(0, (2 / (_SPAN * _DIM)) ** 0.5, (_SPAN * _DIM, _FILTERS)),
        "bias": np.zeros(_FILTERS),
        "out": rng.normal(0, 0.2, 2 * _FILTERS),
        "base": np.zeros(1),
    }
    w["embed"][0] = 0
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    train = np.flatnonzero(~held)
    for _ in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), 64):
            rows = train[lo : lo + 64]
            logit, cache = _forward(w, _encode([views[i] for i in rows]))
            grad = _backward(w, cache, (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows))
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= 0.004 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(w)
    return calibrate(net, net.logits([v for v, h in zip(views, held) if h]), y[held], np.ones(held.sum()))


def _digest(view: str) -> bytes:
    return hashlib.md5(view.encode("utf-8", "surrogatepass")).digest()


def _recall_cut(score: np.ndarray, weight: np.ndarray) -> float:
    """The highest of the scores at or over which RECALL of the weight lies; infinite without any."""
    order = np.argsort(-score, kind="stable")
    held = np.cumsum(weight[order])
    return float(score[order][np.searchsorted(held, RECALL * held[-1] - 1e-9)]) if len(score) else float("inf")


def calibrate(net: Network, logit: np.ndarray, y: np.ndarray, weight: np.ndarray, real: np.ndarray | None = None) -> Network:
    """``net`` with Platt's calibration and the threshold from weighted logits and labels. ``real`` tells findings from made keys: RECALL holds for each of the two."""
    a, b = 1.0, 0.0
    yes, no = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    for _ in range(50):  # Newton steps on the two parameters, with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        r = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(weight * (p - target) * logit).sum() + 1e-3 * (a - 1), (weight * (p - target)).sum() + 1e-3 * b])
        hess = np.array([[(r * logit**2).sum() + 1e-3, (r * logit).sum()], [(r * logit).sum(), r.sum() + 1e-3]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    out = replace(net, scale=float(a), shift=float(b))
    groups = [y == 1] if real is None else [(y == 1) & real, (y == 1) & ~real]
    cut = min(_recall_cut(out.calibrated(logit[g]), weight[g]) for g in groups)
    return replace(out, threshold=cut if np.isfinite(cut) else 0.5)


#: Logits are counted in steps of a hundredth, at most so many to either side.
STEPS = 3_000


def scored(found: DataFrame, net: Network, trained: set[bytes]) -> DataFrame:
    """``step``, ``covered`` and ``n``: how many of all findings that were not trained on have a logit in a step."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [c for row in batch.column("candidates").to_pylist() for c in row if _digest(c["view"]) not in trained]
            step = np.clip(np.floor(100 * net.logits([c["view"] for c in rows])), -STEPS, STEPS).astype(np.int32) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int32()), pa.array([c["covered"] for c in rows], pa.bool_())], ["step", "covered"])

    return found.select("candidates").mapInArrow(run, "step int, covered boolean").groupBy("step", "covered").agg(F.count("*").alias("n"))


def train(found: DataFrame) -> Network:
    """The network from labelled findings, its threshold from all of them; ``found`` must be a stored table."""
    views = found.select(F.explode("candidates").alias("c")).where(F.length("c.view") <= TRAIN_CHARS).groupBy("c.view").agg(F.max("c.covered").alias("covered"))
    half = [hash_sample(views.where(F.col("covered") == s), SAMPLE_ROWS, "view").toPandas() for s in (True, False)]
    views = [v for part in half for v in part["view"].tolist()]
    secret = np.concatenate([part["covered"].to_numpy(bool) for part in half])
    net = fit(views, secret)
    digests = map(_digest, views)
    counted = scored(found, net, {d for d in digests if d[0] % 5}).collect()  # at most two rows to a step
    rng = np.random.default_rng(8)
    contexts = [v for v, s in zip(views, secret) if not s] or views
    made, plain = _made(rng, contexts), _plain(rng, contexts)
    real = np.arange(len(counted) + len(made) + len(plain)) < len(counted)
    logit = np.concatenate([[r.step / 100 for r in counted], net.logits(made), net.logits(plain)])
    y = np.concatenate([[float(r.covered) for r in counted], np.ones(len(made)), np.zeros(len(plain))])
    weight = np.concatenate([[float(r.n) for r in counted], np.ones(len(made) + len(plain))])
    return calibrate(net, logit, y, weight, real)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, pattern counts, base_sha256 and all spans of every row."""
    found = stored(findings(docs), "secret-findings")
    net = train(found)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            base, candidates = batch.column("base").to_pylist(), batch.column("candidates").to_pylist()
            views = [c["view"] for row in candidates for c in row if not c["whole"]]
            sure = iter(net.probability(views) >= net.threshold if views else ())
            spans = []
            for text, row in zip(base, candidates):
                known = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in text.split(",") if x)]
                spans.append(joined(known + [(c["start"], 3, c["stop"]) for c in row if not c["whole"] and next(sure)]))
            digests = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
            kept = [batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")]
            yield pa.RecordBatch.from_arrays([*kept, digests, pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` in ``text``, and ``n_chars``, where there is one, counted anew."""
    net = train(stored(findings(docs), "secret-findings"))
    own, counted = place(docs, "text"), place(docs, "n_chars") if "n_chars" in docs.columns else None
    rows = plain(docs)
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(own).to_pylist()
            for i, raw in enumerate(raw_text(batch, own)):
                spans, runs, text = scan(raw)
                views = [(s, e) for s, e, _, whole in runs if not whole]
                if views:
                    sure = net.probability([window(text, s, e) for s, e in views]) >= net.threshold
                    spans += [(s, 3, e) for (s, e), ok in zip(views, sure) if ok]
                if spans:
                    out, at = [], 0
                    for s, _, e in sorted(spans):
                        if s >= at:
                            out += [text[at:s], mark]
                        at = max(at, e)
                    texts[i] = "".join(out) + text[at:]
            fresh = {own: pa.array(texts, batch.schema.field(own).type)}
            yield pa.RecordBatch.from_arrays([fresh.get(n, batch.column(n)) for n in names], names)

    out = rows.mapInArrow(run, rows.schema)
    if counted:
        out = out.withColumn(counted, F.length(own).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets(table(spark, sf_dir, "documents"))
