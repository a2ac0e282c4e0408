"""Secret scans: where texts hold credentials.

Base patterns give spans that always stay. Method for the rest: a character convolutional network in numpy over every
candidate and the characters around it. Candidates are runs of 16 or more characters of the credential alphabet, and of 8
or more behind a sign of assignment, a word for credentials or a base span; of a run that base spans cover in part, what
they leave. A long one is scored in overlapping windows, and counts as found if any is. The network is trained on
labelled findings, drawn by a seeded generator of credentials and of look-alikes (words of several languages, identifiers,
paths, versions, numbers, dates) in running text; its logits, the highest of a finding's windows, are calibrated on
held-out findings (Platt scaling), and the threshold is the highest that keeps the wanted recall there, with those that
are no candidates counted as missed.

Scale: a map over rows with a network of a few thousand weights in its closure; nothing is shuffled or collected. Rows
are taken by bytes and windows scored as they come, so that memory does not grow with a text's number of candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import spread

from .common import read
from .kernel import by_bytes

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.\-]{8,}={0,2}")
#: What makes a run of 8 to 15 characters a candidate, if it ends before it.
_LEAD = re.compile(r"""(?:[=:]|(?i:\b(?:bearer|basic|pass|password|passwd|pwd|secret|token|key|auth|credentials?)))["'`]?\s{0,2}["'`(]?\Z""")
#: Lengths from which a run is a candidate, anywhere and behind such a lead; bytes of text and windows handled at once.
LONG, SHORT, TEXT_BYTES, SCORED = 16, 8, 4 << 20, 4096

#: Characters before, of and after a candidate that the network sees; longer candidates are windows half a width apart.
BEFORE, INSIDE, AFTER = 24, 64, 16
WIDTH = BEFORE + INSIDE + AFTER
EMBED, KERNEL, FILTERS = 12, 5, 32


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kind as a number, ordered by start and kind; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _left(a: int, b: int, covered: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """What intervals leave of [a, b), and the number of the first interval that ends behind a."""
    while at < len(covered) and covered[at][1] <= a:
        at += 1
    out, k = [], at
    while k < len(covered) and covered[k][0] < b:
        if covered[k][0] > a:
            out.append((a, covered[k][0]))
        a = max(a, covered[k][1])
        k += 1
    if a < b:
        out.append((a, b))
    return out, at


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what the network judges, in order."""
    covered: list[tuple[int, int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
        else:
            covered.append((s, e))
    at = 0
    for m in _RUN.finditer(text):
        parts, at = _left(m.start(), m.end(), covered, at)
        for a, b in parts:
            whole = (a, b) == m.span()
            while a < b and text[a] in "./-_+":
                a += 1
            while a < b and text[b - 1] in "./-_":
                b -= 1
            if b - a >= LONG or (b - a >= SHORT and (not whole or _LEAD.search(text, max(0, a - 24), a))):
                yield a, b


def windows(text: str, a: int, b: int) -> Iterator[bytes]:
    """The candidate and its surroundings, as rows of WIDTH bytes; 0 pads."""
    at = a
    while True:
        end = min(b, at + INSIDE)
        before, after = text[max(0, at - BEFORE) : at], text[end : end + AFTER]
        row = before.rjust(BEFORE, "\0") + text[at:end].ljust(INSIDE, "\0") + after.ljust(AFTER, "\0")
        yield row.encode("ascii", "replace")
        if end == b:
            return
        at = min(at + INSIDE // 2, b - INSIDE)


@dataclass
class Network:
    """Embedding, one convolution, maximum over places, one unit. `scale` and `shift` calibrate its logit."""

    embed: np.ndarray
    conv: np.ndarray
    conv_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def columns(self, rows: np.ndarray) -> np.ndarray:
        """(n, WIDTH) bytes to (n, places, KERNEL * (EMBED + 1)): embeddings, and whether a place is inside the candidate."""
        x = np.empty((*rows.shape, EMBED + 1), np.float32)
        x[..., :EMBED] = self.embed[np.minimum(rows, 127)]
        x[..., EMBED] = 0
        x[:, BEFORE : BEFORE + INSIDE, EMBED] = 1
        view = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1)
        return np.ascontiguousarray(view.swapaxes(2, 3)).reshape(len(rows), WIDTH - KERNEL + 1, -1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        h = np.maximum(self.columns(rows) @ self.conv + self.conv_b, 0)
        pooled = np.concatenate([h.max(1), h[:, BEFORE - 2 : BEFORE + INSIDE - 2].mean(1)], 1)
        return pooled @ self.out + self.out_b

    def probabilities(self, rows: np.ndarray, batch: int = 512) -> np.ndarray:
        parts = [self.logits(rows[k : k + batch]) for k in range(0, len(rows), batch)]
        z = np.concatenate([*parts, np.zeros(0, np.float32)])
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _letters(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGITS


#: Common letter groups of English, German, French and Spanish.
_GROUPS = """th he in er an re nd on en at ou ed ha to or it is hi es ng st ar te se me ve ti al le sh wh ea ly ing and ion tion ble ment ous
ein ich sch keit heit ung ver ge be ber er st tz zu ach eau eux oi que elle le la ai ien ch ado mente cion que el os as ra do ll rr""".split()


def _word(rng: np.random.Generator, n: int = 0) -> str:
    """Something one can say: consonants and vowels in turn, now and then a cluster, or common letter groups."""
    n = n or int(rng.integers(1, 5))
    if rng.random() < 0.5:
        return "".join(_GROUPS[k] for k in rng.integers(0, len(_GROUPS), n + 1))
    parts = []
    for _ in range(n):
        parts.append(_letters(rng, "bcdfghklmnprstvwz", 1 + (rng.random() < 0.2)) + _letters(rng, "aeiou", 1) + ("" if rng.random() < 0.6 else _letters(rng, "nrstl", 1)))
    return "".join(parts)


def _secret(rng: np.random.Generator) -> tuple[str, str]:
    """What a base pattern finds before the secret, mostly nothing, and the secret; with digits in it or without."""
    n = int(rng.integers(20, 48))
    digits = _DIGITS if rng.random() < 0.7 else ""
    kind = rng.integers(0, 10)
    if kind == 0:
        return "", _letters(rng, "0123456789abcdef", int(rng.integers(20, 32)))
    if kind == 1:
        return "", _letters(rng, _LOWER + _UPPER + digits + "+/", n) + "=" * int(rng.integers(0, 3))
    if kind == 2:
        return "", _letters(rng, _LOWER, int(rng.integers(2, 5))) + "_" + ("live_" if rng.random() < 0.3 else "") + _letters(rng, _LOWER + _UPPER + digits, n)
    if kind == 3:
        return "", _letters(rng, _UPPER + digits, n)
    if kind == 4:
        return "", ".".join(("eyJ" if k < 2 else "") + _letters(rng, _ALNUM + "_-", int(rng.integers(16, 90))) for k in range(3))
    if kind == 5:
        return "", _letters(rng, _LOWER + _DIGITS, n)
    if kind == 6:
        return "", _letters(rng, _LOWER + _UPPER + digits, n)
    if kind == 7:
        return "AKIA" + _letters(rng, _UPPER + _DIGITS, 16), "/" + _letters(rng, _ALNUM + "+/", 40)
    if kind == 8:
        return "", _letters(rng, _LOWER + _UPPER + digits, int(rng.integers(10, 16)))
    return "", _letters(rng, _ALNUM + "_-", n)


def _look_alike(rng: np.random.Generator) -> str:
    num = lambda a, b: _letters(rng, _DIGITS, int(rng.integers(a, b)))
    words = [_word(rng) for _ in range(int(rng.integers(2, 6)))]
    kind = rng.integers(0, 14)
    if kind == 0:
        return "/".join([*words, num(1, 5)]) + rng.choice(["", ".html", ".jpg", "/"])
    if kind == 1:
        return rng.choice(["_", "-", "."]).join([*words, num(1, 5)])
    if kind == 2:
        return "".join(w.capitalize() for w in words) + num(1, 4)
    if kind == 3:
        return num(16, 24)
    if kind == 4:
        return f"20{num(2, 3)}-{num(2, 3)}-{num(2, 3)}T{num(2, 3)}.{num(2, 3)}.{num(2, 3)}Z"
    if kind == 5:
        return "-".join(num(3, 6) for _ in range(4))
    if kind == 6:
        return "www." + _word(rng, 4) + rng.choice([".com/", ".org/", ".example.net/"]) + _word(rng) + "-" + num(1, 6)
    if kind == 7:
        return _letters(rng, "-=._", 1) * int(rng.integers(12, 30)) + num(1, 6)
    if kind == 8:
        return _word(rng, 3) + "." + _word(rng, 3) + num(1, 4)
    if kind == 9:
        return _word(rng, int(rng.integers(5, 9))) + num(1, 4)
    if kind == 10:
        return rng.choice(["_", "-", ".", "/"]).join(words)
    if kind == 11:
        return rng.choice([str.upper, str.capitalize, str.lower])(_word(rng, int(rng.integers(5, 10))))
    if kind == 12:
        return "/".join(words) + rng.choice(["/", ".py", ".html", ".txt"])
    return _word(rng, int(rng.integers(2, 5)))


_LEADS = ('key = "', "Authorization: Bearer ", "export AUTH=", "client_id: ", "credentials=", 'auth": "', "-u admin:", "x-access: ", "pwd=", "signature=")


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): credentials (1) and look-alikes (0) in equal shares; short ones behind a lead."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        label = k % 2
        cover, body = _secret(rng) if label else ("", _look_alike(rng))
        text = " ".join(_word(rng) for _ in range(int(rng.integers(0, 6))))
        led = len(body) < LONG or rng.random() < (0.6 if label else 0.2)
        lead = str(rng.choice(_LEADS)) if led else str(rng.choice([" ", "\n", " (", " see ", ": "]))
        text += lead + cover
        at = len(text)
        text += body + str(rng.choice([" ", '"', "\n", ". ", ") "])) + " ".join(_word(rng) for _ in range(int(rng.integers(0, 5))))
        out.append((text, at, at + len(body), label))
    return out


def window_rows(findings: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all candidates that overlap the findings, as bytes, and of which finding each is."""
    rows, of = [], []
    for k, (text, a, b, _) in enumerate(findings):
        for s, e in candidates(text, base_spans(text)):
            if s < b and a < e:
                for w in windows(text, s, e):
                    rows.append(np.frombuffer(w, np.uint8))
                    of.append(k)
    return np.array(rows), np.array(of)


def highest(values: np.ndarray, of: np.ndarray, n: int, none: float) -> np.ndarray:
    """The highest value of each of n findings; `none` for those without a candidate."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, of, values)
    return np.where(np.isinf(out), none, out)


def _fitted(rows: np.ndarray, labels: np.ndarray, seed: int, epochs: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    width = KERNEL * (EMBED + 1)
    net = Network(draw(128, EMBED) * 0.3, draw(width, FILTERS) / np.float32(width**0.5), np.zeros(FILTERS, np.float32), draw(2 * FILTERS) * 0.2, np.zeros(1, np.float32))
    names = ("embed", "conv", "conv_b", "out", "out_b")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step, batch, places = 0, 64, WIDTH - KERNEL + 1
    inside = slice(BEFORE - 2, BEFORE + INSIDE - 2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            x, y = np.minimum(rows[pick], 127), labels[pick]
            cols = net.columns(x)
            pre = cols @ net.conv + net.conv_b
            h = np.maximum(pre, 0)
            top = h.argmax(1)
            pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h[:, inside].mean(1)], 1)
            z = pooled @ net.out + net.out_b
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32) / len(pick)
            dp = dz[:, None] * net.out[None]
            dh = np.zeros_like(h)
            dh[:, inside] = dp[:, None, FILTERS:] / INSIDE
            i, j = np.ogrid[: len(pick), :FILTERS]
            dh[i, top, j] += dp[:, :FILTERS]
            dh *= pre > 0
            dcols = (dh @ net.conv.T).reshape(len(pick), places, KERNEL, EMBED + 1)[..., :EMBED]
            dembed = np.zeros_like(net.embed)
            dx = np.zeros((len(pick), WIDTH, EMBED), np.float32)
            for t in range(KERNEL):
                dx[:, t : t + places] += dcols[:, :, t]
            np.add.at(dembed, x.ravel(), dx.reshape(-1, EMBED))
            grads = {"embed": dembed, "conv": np.tensordot(cols, dh, ((0, 1), (0, 1))), "conv_b": dh.sum((0, 1)), "out": pooled.T @ dz, "out_b": dz.sum(keepdims=True)}
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                rate = 3e-3 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                setattr(net, n, (getattr(net, n) - rate * first[n] / (np.sqrt(second[n]) + 1e-8)).astype(np.float32))
    return net


def calibrated(net: Network, findings: list[tuple[str, int, int, int]], recall: float) -> Network:
    """Platt scaling by Newton steps on held-out findings, then the highest threshold of at least that recall there.

    A finding stands with its highest logit. Credentials that are no candidates count as missed.
    """
    rows, of = window_rows(findings)
    every = np.array([f[3] for f in findings])
    z = highest(np.concatenate([net.logits(rows[k : k + 512]) for k in range(0, len(rows), 512)]).astype(np.float64), of, len(findings), np.nan)
    seen = ~np.isnan(z)
    z, labels = z[seen], every[seen]
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - labels) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    net.scale, net.shift = float(w[0]), float(w[1])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    positive = np.sort(np.concatenate([np.zeros(int((every == 1).sum() - (labels == 1).sum())), p[labels == 1]]))
    net.threshold = float(positive[int(np.floor((1 - recall) * len(positive)))])
    if net.threshold <= 0:
        raise ValueError(f"too many credentials are no candidates for a recall of {recall}")
    return net


@lru_cache(maxsize=2)
def trained(findings: int = 8000, seed: int = 5, epochs: int = 4, recall: float = 0.98) -> Network:
    """The network, from `findings` labelled findings and half as many held out."""
    own = labelled_findings(findings, seed)
    rows, of = window_rows(own)
    net = _fitted(rows, np.array([own[k][3] for k in of], np.float32), seed, epochs)
    return calibrated(net, labelled_findings(findings // 2, seed + 1), recall)


def _scan(texts: list[str], net: Network) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Per text its base spans and all its spans."""
    base = [base_spans(t) for t in texts]
    rows: list[bytes] = []
    of: list[tuple[int, int, int]] = []
    found: set[tuple[int, int, int]] = set()

    def score() -> None:
        p = net.probabilities(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH))
        found.update(of[i] for i in np.flatnonzero(p >= net.threshold))
        rows.clear()
        of.clear()

    for k, text in enumerate(texts):
        for a, b in candidates(text, base[k]):
            for row in windows(text, a, b):
                rows.append(row)
                of.append((k, a, b))
                if len(rows) >= SCORED:
                    score()
    if rows:
        score()
    spans = [list(b) for b in base]
    for k, a, b in found:
        spans[k].append((a, 3, b))
    return base, [sorted(s) for s in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98) -> DataFrame:
    """One row (id, n_assign, n_access, n_hex, n_model, base_sha256, spans) for each row.

    spans: kind:start:end of all findings, by start and then kind, comma-joined; base_sha256: the hash of the base ones
    so joined. Positions are code points, ends exclusive. Null counts as empty: no spans. Ids may be null or repeat;
    whole repeated rows have equal results; further columns are ignored; an empty table gives an empty result.
    """
    net = trained(recall=recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in by_bytes(batch.column(1), TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                base, spans = _scan([t or "" for t in part.column(1).to_pylist()], net)
                count = lambda k, s=spans: pa.array([sum(x[1] == k for x in one) for one in s], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), count(0), count(1), count(2), count(3), pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]), pa.array([_joined(s) for s in spans], pa.string())],
                    names=["id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return found_secrets(spread(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
