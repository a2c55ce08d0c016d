"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF on top.

The network reads overlapping windows of characters and tags each character as outside, or as the
first or a further one of an email, ip, card or phone. It is trained in numpy on generated text in
which the spans are known, and then on windows of the documents, labelled by the fixed patterns. A
window's best tag sequence comes from the CRF's transitions. The windows of a document are reconciled
before spans are cut: where two overlap, each character's tag comes from the window in whose middle it
is, so spans may be of any length and lie at any offset. Of overlapping spans the best scored stays.
Spans of the fixed patterns always stay; an added one may hold a fixed one whole, never cut it.

A span that the network adds must hold what its kind can't do without (an @ between characters, or
enough digits), or more than the fixed span inside it. A window without that outside the fixed spans,
which also touches no letter or digit next to a fixed span, can add nothing; it isn't decoded unless
its neighbour is.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WINDOW, STRIDE = 80, 48
EMBED, HIDDEN = 8, 16
TAGS = 1 + 2 * len(KINDS)
#: Least mean probability of a span's tags for it to be added, and least digits of an added phone.
LEAST_SURE, LEAST_DIGITS = 0.9, 9
TRAIN_WINDOWS, EPOCHS, BATCH, RATE = 5000, 8, 64, 0.01
#: Labelled windows of the documents that the tagger is tuned on at most, those of the texts with the least hashes; windows of one text.
TUNE_WINDOWS, TUNE_EPOCHS, TUNE_RATE, OF_TEXT = 1024, 2, 0.003, 4

_OWN = "@.+-_()/:,;'\"#$%&*=!?[]{}<>|\\\n\t "
CLASSES = 5 + len(_OWN)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(x for x in s if "0" <= x <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind, by start and kind."""
    out = []
    at = text.find("@")
    since = 0
    while at >= 0:
        start = at
        while start > since and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            since = m.end()
            at = text.find("@", since)
        else:
            since = at + 1
            at = text.find("@", since)
    out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def classes(text: str) -> np.ndarray:
    """A class of each character: lower case, upper case, digit, other ASCII, non-ASCII, or one of its own."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = np.full(129, 3, np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    for i, x in enumerate(_OWN):
        table[ord(x)] = 5 + i
    table[128] = 4
    return table[np.minimum(code, 128)]


def training_text(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated windows with their spans: words, numbers and codes that aren't personal, and data in many forms."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick(("an", "er", "ti", "ou", "le", "ch", "st", "ei", "mo", "ra")) for _ in range(int(rng.integers(1, 4))))
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))

    def card() -> str:
        d = pick(("4", "51", "37", "6011")) + num(int(rng.integers(9, 14)))
        d += str(next(c for c in range(10) if luhn(d + str(c))))
        sep = pick(("", " ", "-", ".", "/", "  "))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick((f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b}{c}", f"+{num(1)}{a}{b}{c}", f"+{num(2)}/{a}/{b}-{c}", f"0{a} {b}{c}"))

    def email() -> str:
        name = pick((word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}.{word()}.{word()}{num(2)}", f"{word()}_{word()}", f"{word()}ü{word()}"))
        host = pick((f"{word()}.{pick(('com', 'org', 'net', 'de'))}", f"{word()}-{word()}.{word()}.{pick(('com', 'fr'))}", f"{word()}ö.de", f"{word()}.{word()}ä.{pick(('com', 'de'))}"))
        return name + pick(("@", "@", " @ ", "@ ", " @")) + host

    def ip() -> str:
        sep = pick((".", ".", " . ", "[.]"))
        return sep.join(str(rng.integers(0, 256)) for _ in range(4))

    def other() -> str:
        return pick((word(), word(), word().capitalize(), word() + ",", word() + ".", num(int(rng.integers(1, 6))), num(int(rng.integers(7, 30))), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", f"${num(3)},{num(3)}.{num(2)}", rng.bytes(16).hex(), rng.bytes(20).hex().upper(), f"@{word()}", f"{word()}_{num(6)}", f"{num(3)}:{num(4)}:{num(3)}", word().upper() + "!!", f"{num(2)}:{num(2)}:{num(2)}"))

    made = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < 3 * WINDOW:
            kind = int(rng.integers(0, 14))
            piece = (email, ip, card, phone)[kind]() if kind < 4 else other()
            if kind < 4:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + pick((" ", " ", " ", "\n", ", "))
        made.append(window_of(text, spans, int(rng.integers(0, 2 * WINDOW))))
    return made


def window_of(text: str, spans: list[tuple[int, int, int]], at: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A window of the text with its spans, those that begin before it too (then with a negative start)."""
    return text[at : at + WINDOW], [(a - at, min(b - at, WINDOW), k) for a, b, k in spans if b > at and a < at + WINDOW]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * v) + 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"e": draw(CLASSES, EMBED) * 3, "o": draw(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"x{d}": draw(EMBED, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def _lstm(self, x: np.ndarray, d: str):
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN))
        into = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, kept = np.zeros((n, steps, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = into[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            z = np.tanh(g[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * z
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((t, i, f, o, z, tc, before, c_before))
        return out, kept

    def _lstm_back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, g: dict) -> np.ndarray:
        dh = dc = np.zeros((len(x), HIDDEN))
        dinto = np.zeros((*x.shape[:2], 4 * HIDDEN))
        for t, i, f, o, z, tc, before, c_before in reversed(kept):
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc**2)
            dg = np.concatenate([dc * z * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z**2)], axis=1)
            dinto[:, t] = dg
            g[f"h{d}"] += before.T @ dg
            dh, dc = dg @ self.p[f"h{d}"].T, dc * f
        g[f"x{d}"] += np.einsum("nte,ntg->eg", x, dinto)
        g[f"c{d}"] += dinto.sum((0, 1))
        return dinto @ self.p[f"x{d}"].T

    def emissions(self, code: np.ndarray):
        x = self.p["e"][code]
        (f, kf), (b, kb) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["o"] + self.p["ob"], (x, both, kf, kb)

    def marginals(self, e: np.ndarray):
        """(tag probabilities, pair probabilities summed over steps) of the CRF."""
        n, steps, k = e.shape
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + self.p["s"]
        for t in range(1, steps):
            a[:, t] = e[:, t] + _logsum(a[:, t - 1, :, None] + self.p["t"], 1)
        for t in range(steps - 2, -1, -1):
            b[:, t] = _logsum(self.p["t"] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = _logsum(a[:, -1], 1)
        single = np.exp(a + b - z[:, None, None])
        pairs = np.zeros((k, k))
        for t in range(1, steps):
            pairs += np.exp(a[:, t - 1, :, None] + self.p["t"] + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(0)
        return single, pairs

    def decode(self, e: np.ndarray) -> np.ndarray:
        n, steps, k = e.shape
        score, back = e[:, 0] + self.p["s"], np.zeros((n, steps, k), np.int64)
        for t in range(1, steps):
            total = score[:, :, None] + self.p["t"]
            back[:, t] = total.argmax(1)
            score = total.max(1) + e[:, t]
        tags = np.zeros((n, steps), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def gradient(self, code: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        e, (x, both, kf, kb) = self.emissions(code)
        single, pairs = self.marginals(e)
        n = len(code)
        gold = np.eye(TAGS)[tags]
        de = (single - gold) / n
        counts = np.zeros((TAGS, TAGS))
        np.add.at(counts, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["t"], g["s"] = (pairs - counts) / n, de[:, 0].sum(0)
        g["o"], g["ob"] = np.einsum("nth,ntk->hk", both, de), de.sum((0, 1))
        dboth = de @ self.p["o"].T
        dx = self._lstm_back(x, "f", kf, dboth[:, :, :HIDDEN], g) + self._lstm_back(x, "b", kb, dboth[:, :, HIDDEN:], g)
        np.add.at(g["e"], code.ravel(), dx.reshape(-1, EMBED))
        return g

    def fit(self, made: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, seed: int = 17, most: float = RATE) -> Tagger:
        code = np.full((len(made), WINDOW), 5 + _OWN.index(" "))
        for r, (text, _) in enumerate(made):
            code[r, : len(text)] = classes(text)
        tags = np.zeros_like(code)
        for r, (_, spans) in enumerate(made):
            for start, end, kind in spans:
                tags[r, max(0, start) : end] = 2 + 2 * kind
                if start >= 0:
                    tags[r, start] = 1 + 2 * kind
        rng, step = np.random.default_rng(seed), 0
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(code))
            rate = most * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for at in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
                step += 1
                g = self.gradient(code[at], tags[at])
                norm = np.sqrt(sum((v**2).sum() for v in g.values()))
                for k, v in self.p.items():
                    own = g[k] * min(1, 5 / norm)
                    m[k] += 0.1 * (own - m[k])
                    s[k] += 0.001 * (own**2 - s[k])
                    v -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self


@functools.lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger of generated text, trained once in a process; the same everywhere."""
    return Tagger().fit(training_text(TRAIN_WINDOWS))


def labelled_windows(docs: DataFrame, n: int = TUNE_WINDOWS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``n`` windows around fixed spans of the documents, with all fixed spans in them."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                spans = _apart(base_spans(text))
                for i in range(0, len(spans), max(1, -(-len(spans) // OF_TEXT))):
                    a, b, _ = spans[i]
                    own, inside = window_of(text, spans, max(0, (a + b) // 2 - WINDOW // 2 - (a * 31 + b) % (WINDOW // 2) + WINDOW // 4))
                    rows.append({"text": own, "spans": [list(x) for x in inside]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]))

    some = docs.filter(F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]|\+[0-9][ ().0-9-]{8}|([0-9][ -]?){12}")).select("text").distinct()
    found = some.mapInArrow(run, "text string, spans array<array<long>>").orderBy(F.xxhash64("text"), "text").limit(n).collect()
    return [(r["text"], [tuple(x) for x in r["spans"]]) for r in found]


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans of several kinds that overlap, the longest, so that each character has one tag."""
    kept: list[tuple[int, int, int]] = []
    for a, b, k in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, k))
    return sorted(kept)


def tuned(docs: DataFrame) -> Tagger:
    """The tagger, tuned on windows of the documents and as many generated ones."""
    own = labelled_windows(docs)
    base = trained()
    if not own:
        return base
    tagger = Tagger()
    tagger.p = {k: v.copy() for k, v in base.p.items()}
    return tagger.fit(own + training_text(len(own), seed=23), epochs=TUNE_EPOCHS, most=TUNE_RATE)


def fits(kind: int, s: str) -> bool:
    """What an added span must hold."""
    d = _digits(s)
    if kind == 0:
        left, mark, right = s.partition("@")
        return bool(mark and left.strip() and "." in right.strip(" ."))
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(0 < len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return LEAST_DIGITS <= len(d) <= 15


def windows(text: str, base: list[tuple[int, int, int]]) -> list[int]:
    """Numbers of the windows to decode: those that can add a span, and their neighbours; window i begins at i * STRIDE.

    A window can if it has an @ or four digits outside the fixed spans, or a letter or digit right beside one.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    digit, mark = (code >= 48) & (code <= 57), code == 64
    for start, end, _ in base:
        digit[start:end] = mark[start:end] = False
    for start, end, _ in base:
        for i in (start - 1, end):
            if 0 <= i < len(text) and text[i].isalnum() and not any(a <= i < b for a, b, _ in base):
                mark[i] = True
    d, a = (np.append(0, np.cumsum(x)) for x in (digit, mark))
    n = max(1, -(-(len(text) - WINDOW + STRIDE) // STRIDE))
    starts = np.arange(n) * STRIDE
    ends = np.minimum(len(text), starts + WINDOW)
    can = (d[ends] - d[starts] >= 4) | (a[ends] > a[starts])
    can[1:], can[:-1] = can[1:] | can[:-1], can[:-1] | can[1:]
    return np.flatnonzero(can).tolist()


def _stretches(numbers: list[int]) -> list[list[int]]:
    """Runs of consecutive windows."""
    out: list[list[int]] = []
    for w in numbers:
        if out and out[-1][-1] == w - 1:
            out[-1].append(w)
        else:
            out.append([w])
    return out


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """The spans that the tagger adds to each text."""
    tasks = [(i, w) for i, t in enumerate(texts) for w in windows(t, bases[i])]
    tags, sure = {}, {}
    for at in range(0, len(tasks), 512):
        own = tasks[at : at + 512]
        code = np.full((len(own), WINDOW), 5 + _OWN.index(" "))
        for r, (i, w) in enumerate(own):
            part = classes(texts[i][w * STRIDE : w * STRIDE + WINDOW])
            code[r, : len(part)] = part
        e, _ = tagger.emissions(code)
        best, single = tagger.decode(e), tagger.marginals(e)[0]
        of_tag = np.take_along_axis(single, best[:, :, None], 2)[:, :, 0]
        for r, task in enumerate(own):
            tags[task], sure[task] = best[r].astype(np.int8), of_tag[r].astype(np.float32)
    margin = (WINDOW - STRIDE) // 2
    of_text: list[list[int]] = [[] for _ in texts]
    for i, w in tasks:
        of_text[i].append(w)
    out = []
    for i, text in enumerate(texts):
        found = []
        for run in _stretches(of_text[i]):
            found += _cut_spans(text, run, [tags[i, w] for w in run], [sure[i, w] for w in run], margin)
        kept: list[tuple[int, int, int]] = []
        for _, a, b, kind in sorted(set(found)):
            inner = [(x, y, k) for x, y, k in bases[i] if x < b and y > a]
            whole = all(a <= x and y <= b for x, y, _ in inner) and (a, b) not in {(x, y) for x, y, _ in inner}
            # More of a fixed span of its own kind, or a span of its own; never one that other kinds fill.
            if whole and all(k == kind for *_, k in inner) and all(b <= x or a >= y for x, y, _ in kept):
                kept.append((a, b, kind))
        out.append(sorted(kept))
    return out


def _cut_spans(text: str, run: list[int], tags: list[np.ndarray], sure: list[np.ndarray], margin: int) -> list[tuple[float, int, int, int]]:
    """(-score, start, end, kind) of the spans in a stretch of windows, each character tagged by the window in whose middle it is."""
    since = run[0] * STRIDE
    cut = [(0 if r == 0 else margin, WINDOW if r == len(run) - 1 else WINDOW - margin) for r in range(len(run))]
    tag = np.concatenate([t[a:b] for t, (a, b) in zip(tags, cut, strict=True)])
    p = np.concatenate([t[a:b] for t, (a, b) in zip(sure, cut, strict=True)])
    tag = tag[: max(0, len(text) - since)]
    kind = np.where(tag > 0, (tag.astype(np.int64) - 1) // 2, -1)
    new = np.ones(len(tag), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (tag[1:] % 2 == 1)
    begin = np.flatnonzero(new)
    out = []
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(tag)).tolist(), strict=True):
        score = float(p[a:b].mean()) if kind[a] >= 0 else 0.0
        if score >= LEAST_SURE and fits(int(kind[a]), text[since + a : since + b]):
            out.append((-score, since + a, since + b, int(kind[a])))
    return out


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, a count for each kind and base_sha256 of the fixed patterns' spans, and spans: all spans, the tagger's too.

    Places are code points, ends exclusive. Whole texts are read; null and empty texts hold nothing
    (counts 0, spans empty). Null and repeated doc_ids are kept, and equal texts get equal spans;
    more columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or tuned(docs))

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                some = ((c.data >= 0x30) & (c.data <= 0x39)) | (c.data == 0x40)
                upto = np.append(0, np.cumsum(some))
                hits = np.flatnonzero(upto[c.offsets[1:]] > upto[c.offsets[:-1]])
                texts = [c.text(r).decode() for r in hits]
                bases = [base_spans(t) for t in texts]
                more = added_spans(texts, bases, shared.value)
                counts = np.zeros((c.rows, len(KINDS)), np.int64)
                base_list, all_list = [""] * c.rows, [""] * c.rows
                for r, base, extra in zip(hits.tolist(), bases, more, strict=True):
                    for _, _, kind in base:
                        counts[r, kind] += 1
                    base_list[r], all_list[r] = _listed(base), _listed([*base, *extra])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()).slice(c.first, c.rows),
                        *(pa.array(counts[:, k]) for k in range(len(KINDS))),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base_list]),
                        pa.array(all_list),
                    ],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
