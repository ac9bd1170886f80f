"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans to them.

The network is trained in numpy on labelled spans: excerpts of a bounded sample of the documents, labelled by the patterns, and the
same contexts with made-up items in forms that the patterns don't know (a phone number without a plus sign, an address with blanks,
a token or key, which is a kind of its own: ``secret``). Texts are cut
into overlapping windows; windows are decoded in batches, and a weighted choice of spans that don't overlap reconciles
them over the whole text. Only windows around digits and at signs are decoded: every kind has one of them, and a decoded span without one
would be dropped, so nothing is lost by it. A span that windows cut is put together from its overlapping pieces.

Documents are only mapped; the model is the one broadcast, of a few dozen kB.

Edge cases: null is the empty text, which has no spans. Offsets are code points, ends exclusive. Repeated rows give repeated results; a
null doc_id stays null. Redaction keeps all columns and sets ``n_chars``, where there is one, to the new length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import tidy

#: The last has no pattern: only the network finds it.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Documents that excerpts are taken from, excerpts used, steps and rows of a step of the training.
SAMPLE, EXCERPTS, STEPS, ROWS = 3000, 4000, 400, 32
#: Characters of a training excerpt, of a decoded window, from one window to the next, and around a digit or at sign.
LENGTH, WINDOW, STRIDE, AROUND = 64, 128, 64, 40
#: Least mean of the marginal probabilities of an added span's characters.
SURE = 0.8
HIDDEN, EMBED = 16, 12
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ANCHOR = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    """A number up to 255. The network's spans may hold anything, blanks beside the number are let pass."""
    part = part.strip()
    return part.isascii() and part.isdigit() and len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def _fine(kind: int, s: str) -> bool:
    """What a match must meet besides its pattern."""
    if kind == 1:
        return all(map(_octet, s.split(".")))
    if kind == 2:
        return 12 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == 3:
        return 9 <= len(_digits(s)) <= 15
    return True


def _plausible(kind: int, s: str) -> bool:
    if kind == 0:
        return s.count("@") == 1 and "." in s.split("@")[1] and not s.startswith("@")
    if kind == 4:
        return len(s) >= 16 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and not any(c.isspace() for c in s)
    return _fine(kind, s) and (kind != 1 or s.count(".") == 3) and s[-1] in "0123456789"


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind's pattern that don't overlap; failing ones are dropped. Linear in the text."""
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _fine(kind, m[0])]
    return sorted(out)


def listing(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- the network

_PAD, _UPPER, _SPACE, _NEWLINE, _LETTER, _OTHER = 0, 27, 70, 71, 72, 73
_IDS = np.full(128, _OTHER)
_IDS[97:123] = np.arange(1, 27)
_IDS[65:91] = _UPPER
_IDS[48:58] = np.arange(28, 38)
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_IDS[_PUNCTUATION] = np.arange(38, 38 + len(_PUNCTUATION))
_IDS[[32, 9, 13]] = _SPACE
_IDS[10] = _NEWLINE
SYMBOLS = 74


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _IDS[np.minimum(codes, 127)], _LETTER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Embedding, a forward and a backward LSTM, a linear layer, and a CRF over tags. All weights are float32 arrays."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)

        def weights(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = {"embed": weights(SYMBOLS, EMBED) * 3, "out": weights(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": weights(EMBED, 4 * HIDDEN), f"h{d}": weights(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
        self.ban = np.zeros((TAGS, TAGS), np.float32)  # I of a kind follows B or I of it
        for k in range(len(KINDS)):
            inner = 2 + 2 * k
            self.ban[:, inner] = -1e4
            self.ban[[inner - 1, inner], inner] = 0

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """One direction over (rows, steps, EMBED): hidden states and what the gradient needs."""
        n, steps, _ = x.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"h{d}"]
            s = _sigmoid(z)
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 3 * HIDDEN :], np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            before, h0 = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[:, t] = h
            kept.append((t, i, f, g, o, before, th, h0))
        return out, kept

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.w["embed"][ids]
        (hf, kf), (hb, kb) = self._run(x, "f"), self._run(x, "b")
        h = np.concatenate([hf, hb], 2)
        return h @ self.w["out"] + self.w["bias"], (x, h, kf, kb)

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag probabilities (rows, steps, tags), the mean pair counts, and log normalisers."""
        n, steps, _ = e.shape
        move = self.w["move"] + self.ban
        a, b = np.empty_like(e), np.zeros_like(e)
        start = np.zeros(TAGS, np.float32)
        start[2::2] = -1e4
        a[:, 0] = e[:, 0] + start
        for t in range(1, steps):
            s = a[:, t - 1, :, None] + move
            m = s.max(1)
            a[:, t] = e[:, t] + m + np.log(np.exp(s - m[:, None]).sum(1))
        for t in range(steps - 2, -1, -1):
            s = move + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            m = s.max(2)
            b[:, t] = m + np.log(np.exp(s - m[..., None]).sum(2))
        m = a[:, -1].max(1)
        z = m + np.log(np.exp(a[:, -1] - m[:, None]).sum(1))
        p = np.exp(a + b - z[:, None, None])
        pairs = np.zeros((TAGS, TAGS), np.float64)
        for t in range(1, steps):
            pairs += np.exp(a[:, t - 1, :, None] + move + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(0)
        return p, pairs, z

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tag sequences (Viterbi)."""
        n, steps, _ = e.shape
        move = self.w["move"] + self.ban
        best = e[:, 0].copy()
        best[:, 2::2] -= 1e4
        back = np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + move
            back[t] = s.argmax(1)
            best = s.max(1) + e[:, t]
        out = np.empty((n, steps), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        e, (x, h, kf, kb) = self.emissions(ids)
        p, pairs, z = self.marginals(e)
        n, steps, _ = e.shape
        move = self.w["move"] + self.ban
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
        gold = e[rows, cols, tags].sum(1) + move[tags[:, :-1], tags[:, 1:]].sum(1)
        de = p.copy()
        de[rows, cols, tags] -= 1
        de /= n
        g: dict[str, np.ndarray] = {}
        true = np.zeros((TAGS, TAGS))
        np.add.at(true, (tags[:, :-1], tags[:, 1:]), 1)
        g["move"] = ((pairs - true) / n).astype(np.float32)
        g["bias"] = de.sum((0, 1))
        g["out"] = np.tensordot(h, de, ((0, 1), (0, 1)))
        dh = de @ self.w["out"].T
        dx = np.zeros_like(x)
        for d, kept, part in (("f", kf, dh[..., :HIDDEN]), ("b", kb, dh[..., HIDDEN:])):
            dpre = np.empty((n, steps, 4 * HIDDEN), np.float32)
            back_h = back_c = np.zeros((n, HIDDEN), np.float32)
            g[f"h{d}"] = np.zeros_like(self.w[f"h{d}"])
            for t, i, f, gg, o, before, th, h0 in reversed(kept):
                hh = part[:, t] + back_h
                cc = back_c + hh * o * (1 - th * th)
                dz = np.concatenate([cc * gg * i * (1 - i), cc * before * f * (1 - f), cc * i * (1 - gg * gg), hh * th * o * (1 - o)], 1)
                dpre[:, t] = dz
                g[f"h{d}"] += h0.T @ dz
                back_h, back_c = dz @ self.w[f"h{d}"].T, cc * f
            g[f"b{d}"] = dpre.sum((0, 1))
            g[f"x{d}"] = np.tensordot(x, dpre, ((0, 1), (0, 1)))
            dx += dpre @ self.w[f"x{d}"].T
        g["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(g["embed"], ids, dx)
        return float((z - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, rows: int = ROWS, seed: int = 6) -> float:
        """Adam with gradient clipping; the mean loss of the last steps."""
        r = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick = r.integers(0, len(ids), rows)
            loss, g = self.gradient(ids[pick], tags[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = 0.02 * min(1.0, 1.6 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return float(np.mean(losses[-20:]))


# ---- training rows


def _made_up(r: np.random.Generator) -> tuple[str, str, str, int]:
    """An item, what stands before and after it, and its kind, or a look-alike and -1."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    w = lambda a, b: "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(a, b))))
    host = w(3, 9) + r.choice([".com", ".org", ".net", ".example.com", ".co.uk", ".de"])
    a, b, c = d(3), d(3), d(4)
    luhned = d(15)
    luhned = next(luhned + str(x) for x in range(10) if luhn(luhned + str(x)))
    ip = ".".join(map(str, r.integers(0, 256, 4)))
    code = "".join(r.choice(list("0123456789abcdef"), int(r.choice([24, 32, 40, 40, 48, 64]))))
    word = r.choice(["token", "key", "secret", "password", "auth"])
    secret = (code, code.upper(), "AKIA" + "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)), "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"), int(r.integers(20, 44)))))[int(r.integers(0, 4))]
    around = ((f'{word} = "', '"'), (f'{word.upper()} = "', '"'), (f"{word}: ", ""), (f"{word}=", ""), ('"', '"'), ("", ""))[int(r.integers(0, 6))]
    forms = (
        (f"{w(2, 8)}{r.choice(['', '.', '_', '-'])}{w(2, 8)}{d(int(r.integers(0, 3)))}@{host}", 0),
        (f"{w(3, 8)} @ {host}", 0),
        (f"{w(3, 8)}@ {host}", 0),
        (ip, 1),
        (luhned, 2),
        (r.choice(["-", " "]).join(luhned[i : i + 4] for i in range(0, 16, 4)), 2),
        (f"+{r.integers(1, 99)} ({a}) {b}-{c}", 3),
        (f"+{r.integers(1, 99)} {a} {b} {c}", 3),
        (f"({a}) {b}-{c}", 3),
        (f"{a}-{b}-{c}", 3),
        (f"{a}.{b}.{c}", 3),
        (f"00{r.integers(20, 99)} {d(2)} {d(4)} {d(3)}", 3),
        (f"{r.integers(1, 9)}.{r.integers(0, 20)}", -1),
        (f"{r.integers(1, 9)}.{r.integers(0, 20)}.{r.integers(0, 20)}", -1),
        (f"{r.integers(1900, 2100)}-{r.integers(10, 13)}-{r.integers(10, 29)}", -1),
        (f"{r.integers(10, 24)}:{r.integers(10, 60)}", -1),
        (d(int(r.integers(1, 9))), -1),
        (d(16), -1),
        (d(16), -1),
        (f"{d(16)} {d(16)}", -1),
        (secret, 4),
        (secret, 4),
        (secret, 4),
        (f"{w(4, 9)}-{w(4, 9)}-{d(1)}", -1),
        (f"@{w(3, 8)}", -1),
        (f"{d(3)},{d(3)}.{d(2)}", -1),
    )
    item, kind = forms[int(r.integers(0, len(forms)))]
    return item, *(around if kind == 4 else ("", "")), kind


def training_rows(excerpts: list[str], n: int = EXCERPTS, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Excerpts with their patterns' spans, and excerpts with made-up items put in."""
    r = np.random.default_rng(seed)
    excerpts = sorted(set(excerpts)) or ["a text of some plain words and no more than that, as it stands in a file"]
    ids, tags = np.zeros((n, LENGTH), np.int64), np.zeros((n, LENGTH), np.int64)
    for row in range(n):
        text = excerpts[int(r.integers(0, len(excerpts)))]
        spans = base_spans(text)
        if row % 4:
            item, before, after, kind = _made_up(r)
            plain = _ANCHOR.sub("", text)
            blanks = [i for i, c in enumerate(plain[: max(1, LENGTH - len(item) - len(before) - 2)]) if c in " \n"] or [0]
            at = blanks[int(r.integers(0, len(blanks)))]
            text = f"{plain[:at]} {before}{item}{after}{r.choice([' ', ' ', '.', ',', chr(10), '!!', '###'])}{plain[at:].lstrip()}"
            at += 1 + len(before)
            spans = [(at, kind, at + len(item))] if kind >= 0 else []
        text = text[:LENGTH]
        ids[row, : len(text)] = symbols(text)
        for a, k, b in spans:
            if a < len(text):
                tags[row, a] = 1 + 2 * k
                tags[row, a + 1 : b] = 2 + 2 * k
    return ids, tags


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Fits the network on excerpts of about ``sample`` documents, drawn by the hash of doc_id and text; equal excerpts count once."""
    share = min(1.0, sample / max(1, docs.select("doc_id").count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    out.append(text[:LENGTH])
                    m = _ANCHOR.search(text)
                    if m:
                        lo = max(0, m.start() - LENGTH // 3)
                        out.append(text[lo : lo + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["excerpt"])

    excerpts = drawn.mapInArrow(tidy(run), "excerpt string").distinct().toArrow().column("excerpt").to_pylist()
    tagger = Tagger()
    tagger.fit(*training_rows(excerpts))
    return tagger


# ---- whole texts


def _windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the stretches around digits and at signs."""
    out: list[tuple[int, int]] = []
    start = stop = -1
    stretches = []
    for m in _ANCHOR.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if stop >= lo:
            stop = hi
        else:
            if stop >= 0:
                stretches.append((start, stop))
            start, stop = lo, hi
    if stop >= 0:
        stretches.append((start, stop))
    for lo, hi in stretches:
        while True:
            out.append((lo, min(lo + WINDOW, hi)))
            if lo + WINDOW >= hi:
                break
            lo += STRIDE
    return out


def _reconcile(found: dict[Span, float], fixed: list[Span]) -> list[Span]:
    """The spans of greatest total weight that overlap neither each other nor a fixed one."""
    edges = sorted((a, b) for a, _, b in fixed)
    starts = np.array([a for a, _ in edges], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in edges], np.int64)) if edges else starts
    free = []
    for (a, k, b), weight in found.items():
        i = int(np.searchsorted(starts, b, "left"))
        if i == 0 or reach[i - 1] <= a:
            free.append((b, a, k, weight))
    free.sort()
    ends = np.array([f[0] for f in free], np.int64)
    best = [(0.0, None, None)]
    for b, a, k, weight in free:
        i = int(np.searchsorted(ends[: len(best) - 1], a, "right"))
        take = best[i][0] + weight
        best.append((take, (a, k, b), i) if take > best[-1][0] else (best[-1][0], None, len(best) - 1))
    out, i = [], len(best) - 1
    while i > 0:
        if best[i][1]:
            out.append(best[i][1])
        i = best[i][2]
    return out


def find(texts: list[str | None], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) if t and _ANCHOR.search(t) else [] for t in texts]
    cut = [(d, lo, hi) for d, t in enumerate(texts) if t and _ANCHOR.search(t) for lo, hi in _windows(t)]
    found: list[dict[Span, float]] = [{} for _ in texts]
    parts: list[list[Span]] = [[] for _ in texts]  # what an edge of a window cuts
    for at in range(0, len(cut), 256):
        part = cut[at : at + 256]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for row, (d, lo, hi) in enumerate(part):
            ids[row, : hi - lo] = symbols(texts[d][lo:hi])
        e, _ = tagger.emissions(ids)
        tags = tagger.decode(e)
        if not tags.any():
            continue
        sure = np.take_along_axis(tagger.marginals(e)[0], tags[..., None], 2)[..., 0]
        for row in np.flatnonzero(tags.any(1)).tolist():
            d, lo, hi = part[row]
            own = tags[row, : hi - lo]
            for a in np.flatnonzero(own % 2 == 1).tolist():
                kind = (int(own[a]) - 1) // 2
                b = a + 1
                while b < len(own) and own[b] == 2 + 2 * kind:
                    b += 1
                p = float(sure[row, a:b].mean())
                if p < SURE:
                    continue
                if (b == hi - lo and hi < len(texts[d])) or (a == 0 and lo > 0):
                    parts[d].append((lo + a, kind, lo + b))
                elif _plausible(kind, texts[d][lo + a : lo + b]):
                    span = (lo + a, kind, lo + b)
                    found[d][span] = max(found[d].get(span, 0.0), p * (b - a))
    for d, pieces in enumerate(parts):
        for a, k, b in _joined(pieces):
            if _plausible(k, texts[d][a:b]):
                found[d].setdefault((a, k, b), SURE * (b - a))
    return [(b, sorted(b + _reconcile(f, b)) if f else b) for b, f in zip(base, found, strict=True)]


def _joined(pieces: list[Span]) -> list[Span]:
    """Spans longer than a window's overlap: pieces of one kind that overlap are one span; a piece alone is part of what the next window holds whole."""
    out: list[list[int]] = []
    for a, k, b in sorted(pieces, key=lambda s: (s[1], s[0], s[2])):
        if out and out[-1][1] == k and a < out[-1][2]:
            out[-1][2:] = [max(b, out[-1][2]), out[-1][3] + 1]
        else:
            out.append([a, k, b, 1])
    return [(a, k, b) for a, k, b, n in out if n > 1]


def detect(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, the number of spans of each pattern's kind, base_sha256, spans, n_secret, n_added of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train(docs))
    counted = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = find(part.column("text").to_pylist(), shared.value)
                counts = [pa.array([sum(k == kind for _, k, _ in every) for _, every in rows], pa.int64()) for kind in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(listing(b).encode()).hexdigest() for b, _ in rows], pa.string())
                spans = pa.array([listing(every) for _, every in rows], pa.string())
                added = pa.array([len(every) - len(b) for b, every in rows], pa.int64())
                columns = [part.column("doc_id"), *counts[:4], digests, spans, *counts[4:], added]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counted[:4], "base_sha256", "spans", *counted[4:], "n_added"])

    fields = [f"{c} long" for c in counted]
    schema = ", ".join(["doc_id long", *fields[:4], "base_sha256 string", "spans string", *fields[4:], "n_added long"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping ones, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """The documents with personal data replaced in ``text``, all columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column("text").to_pylist()
                new = [redacted(t, every) if t and every else t for t, (_, every) in zip(texts, find(texts, shared.value), strict=True)]
                columns = dict(zip(names, part.columns, strict=True))
                columns["text"] = pa.array(new, columns["text"].type)
                if "n_chars" in columns:
                    old = columns["n_chars"]
                    columns["n_chars"] = pa.array([len(t) if t is not None and t != o else n for t, o, n in zip(new, texts, old.to_pylist(), strict=True)], old.type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return docs.mapInArrow(tidy(run), docs.schema)
