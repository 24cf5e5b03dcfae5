"""Personal data: pattern spans, and those that a character BiLSTM-CRF trained in numpy adds."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_sample, mapped, read

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window's start to the next; a span of under WINDOW - STRIDE lies whole in one.
WINDOW, STRIDE = 144, 48
#: Windows decoded at a time; wider ones are so many fewer, and one alone is at most CHUNK times as wide.
CHUNK = 512
EMBED, HIDDEN, TAGS = 12, 20, 1 + 2 * len(KINDS)
SURE = 0.9
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start inside a run of digits: what fails at the run's start fails there too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]+")
_DIGIT = re.compile(r"[0-9]")
_ADDRESS_BEGUN = re.compile(r"[A-Za-z0-9._%+-]++(?:\s++)?(?:@\s*+(?:[A-Za-z0-9-]++\s?\.\s?)*+[A-Za-z0-9-]*+\s?)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def at_most_255(digits: str) -> bool:
    """Also of very many digits, which int() refuses."""
    d = digits.lstrip("0")
    return len(d) <= 3 and int(d or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, in time linear in the text: from each @ to both sides."""
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))
        last = max(last, 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches that pass their kind's test, by start and then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(at_most_255(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def plausible(kind: int, s: str) -> bool:
    """Whether what the model marks passes the kind's test, whatever stands between its parts."""
    digits = re.sub(r"[^0-9]", "", s)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9-]+(?:\s?\.\s?[A-Za-z0-9-]+)+", s))
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def unfinished(kind: int, s: str, before: str) -> bool:
    """Whether s, after the character `before`, may begin a longer span that passes its kind's test.

    The starts of which that holds and that reach over one place are few, so that following them takes linear time: an
    address begins where its run of characters does, and a number has few digits, one of them at its beginning.
    """
    if kind == 0:
        return before not in _LOCAL and bool(_ADDRESS_BEGUN.fullmatch(s))
    return bool(_DIGIT.search(s[:3])) and len(_DIGIT.findall(s)) <= (0, 12, 19, 15)[kind]


def code(c: str) -> int:
    """Id of a character: printable ASCII one by one, then line ends, other letters, the rest; 0 is padding."""
    o = ord(c)
    return o - 31 if 32 <= o < 127 else 96 if c == "\n" else 97 if c.isalpha() else 98


def codes(text: str, width: int = WINDOW) -> np.ndarray:
    out = np.zeros(width, np.int64)
    out[: len(text)] = [code(c) for c in text]
    return out


class Net:
    """Embedding, an LSTM each way, tag scores, CRF transitions. Arrays are (time, batch, ...)."""

    NAMES = ("emb", "wf", "uf", "bf", "wb", "ub", "bb", "out", "bias", "trans")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def fresh(rng: np.random.Generator) -> Net:
        def r(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        forget = np.zeros(4 * HIDDEN, np.float32)
        forget[HIDDEN : 2 * HIDDEN] = 1
        return Net({"emb": rng.normal(0, 0.5, (99, EMBED)).astype(np.float32), "wf": r(EMBED, 4 * HIDDEN), "uf": r(HIDDEN, 4 * HIDDEN), "bf": forget, "wb": r(EMBED, 4 * HIDDEN), "ub": r(HIDDEN, 4 * HIDDEN), "bb": forget.copy(), "out": r(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)})

    def _run(self, x: np.ndarray, side: str):
        """Hidden states and what the way back needs."""
        u, pre = self.p["u" + side], x @ self.p["w" + side] + self.p["b" + side]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        hs, cs, gates = [h], [c], []
        for t in range(len(x)):
            z = pre[t] + h @ u
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            s[:, 2 * HIDDEN : 3 * HIDDEN] = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            i, f, g, o = (s[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            c = f * c + i * g
            h = o * np.tanh(c)
            hs.append(h), cs.append(c), gates.append(s)
        return np.stack(hs[1:]), (hs, cs, gates)

    def _back(self, x: np.ndarray, side: str, kept, dh_all: np.ndarray, grads: dict) -> np.ndarray:
        hs, cs, gates = kept
        u, w = self.p["u" + side], self.p["w" + side]
        dz_all = np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, g, o = (gates[t][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh = dh + dh_all[t]
            tc = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[:, :HIDDEN] = dc * g * i * (1 - i)
            dz[:, HIDDEN : 2 * HIDDEN] = dc * cs[t] * f * (1 - f)
            dz[:, 2 * HIDDEN : 3 * HIDDEN] = dc * i * (1 - g * g)
            dz[:, 3 * HIDDEN :] = dh * tc * o * (1 - o)
            dc, dh = dc * f, dz @ u.T
        grads["u" + side] = np.einsum("tbh,tbk->hk", np.stack(hs[:-1]), dz_all)
        grads["w" + side] = np.einsum("tbe,tbk->ek", x, dz_all)
        grads["b" + side] = dz_all.sum((0, 1))
        return dz_all @ w.T

    def emissions(self, ids: np.ndarray):
        """Tag scores for windows `ids` (batch, time), and what the way back needs."""
        x = self.p["emb"][ids.T]
        hf, kf = self._run(x, "f")
        hb, kb = self._run(x[::-1], "b")
        h = np.concatenate([hf, hb[::-1]], 2)
        return h @ self.p["out"] + self.p["bias"], (x, h, kf, kb)

    @staticmethod
    def allowed() -> np.ndarray:
        """A large negative number where a tag can't follow another: inside a kind comes only after that kind."""
        ban = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            ban[:, 2 + 2 * k] = -1e4
            ban[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        return ban

    def chains(self, em: np.ndarray):
        """Log sums of the paths up to and from each place, and over all."""
        trans = self.p["trans"] + self.allowed()
        first = np.zeros(TAGS, np.float32)
        first[2::2] = -1e4
        a = [em[0] + first]
        for t in range(1, len(em)):
            a.append(em[t] + lse(a[-1][:, :, None] + trans, 1))
        b = [np.zeros_like(em[0])]
        for t in range(len(em) - 1, 0, -1):
            b.append(lse(trans + (em[t] + b[-1])[:, None, :], 2))
        return np.stack(a), np.stack(b[::-1]), lse(a[-1], 1), trans

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        em, (x, h, kf, kb) = self.emissions(ids)
        a, b, z, trans = self.chains(em)
        n, y = len(ids), tags.T
        grads: dict = {}
        d = np.exp(a + b - z[:, None])
        np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
        d /= n
        pair = np.exp(a[:-1, :, :, None] + trans + (em[1:] + b[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
        grads["trans"] = pair / n
        grads["out"], grads["bias"] = np.einsum("tbh,tbk->hk", h, d), d.sum((0, 1))
        dh = d @ self.p["out"].T
        dx = self._back(x, "f", kf, dh[:, :, :HIDDEN], grads) + self._back(x[::-1], "b", kb, dh[::-1, :, HIDDEN:], grads)[::-1]
        grads["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grads["emb"], ids.T, dx)
        path = np.take_along_axis(em, y[:, :, None], 2)[..., 0].sum(0) + trans[y[:-1], y[1:]].sum(0)
        return float((z - path).mean()), grads

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window (batch, time), and each tag's probability there."""
        em, _ = self.emissions(ids)
        a, b, z, trans = self.chains(em)
        v, back = a[0], []
        for t in range(1, len(em)):
            s = v[:, :, None] + trans
            back.append(s.argmax(1))
            v = em[t] + s.max(1)
        tag = v.argmax(1)
        tags = [tag]
        for k in reversed(back):
            tag = k[np.arange(len(tag)), tag]
            tags.append(tag)
        tags = np.stack(tags[::-1], 1)
        sure = np.exp(a + b - z[:, None]).transpose(1, 0, 2)
        return tags, np.take_along_axis(sure, tags[:, :, None], 2)[..., 0]


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def tagged(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.zeros(WINDOW, np.int64)
    for a, b, k in spans:
        tags[max(0, a) : b] = 2 + 2 * k
        if a >= 0:
            tags[a] = 1 + 2 * k
    return codes(text), tags


def invented(rng: np.random.Generator) -> tuple[str, int]:
    """A labelled span in one of the spellings that the patterns miss or take."""

    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    kind = int(rng.integers(0, 4))
    if kind == 0:
        name = "".join(rng.choice(list("abcdefghijklmnoprstuvw"), int(rng.integers(3, 9))))
        gap = rng.choice(["", "", " "])
        return f"{name}.{number(2)}{gap}@{gap}{rng.choice(['mail', 'post', 'example'])}{rng.integers(0, 10)}.{rng.choice(['example', 'inbox'])}.{rng.choice(['com', 'org', 'net'])}", kind
    if kind == 1:
        dot = rng.choice([".", ".", " . ", ". ", "[.]"])
        return dot.join(str(x) for x in rng.integers(1, 256, 4)), kind
    if kind == 2:
        d = str(rng.choice(["4", "51", "37"])) + number(12)
        d += next(str(x) for x in range(10) if luhn(d + str(x)))
        sep = rng.choice(["", "", " ", "-", ".", "  ", " - ", "/"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)), kind
    a, b, c = number(3), number(3), number(4)
    return str(rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"+{rng.integers(1, 9)}/{a}/{b}-{c}"])), kind


def drawn(text: str, places: int, plain: int) -> tuple[list[tuple[str, list]], list[str]]:
    """Windows of a text with their pattern spans, around `places` random ones of all its digits and @, and up to `plain` windows without any.

    Depends on the text alone. Spans that a window cuts on its left aren't marked in it, as decoding leaves those to
    the window before.
    """
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    spans, signs = base_spans(text), [m.start() for m in _SIGN.finditer(text)]
    starts = [s[0] for s in spans]
    rows = []
    for at in rng.choice(signs, min(places, len(signs)), replace=False).tolist() if signs else ():
        a = max(0, at - int(rng.integers(0, WINDOW - 8)))
        near = spans[bisect.bisect_left(starts, a) : bisect.bisect_left(starts, a + WINDOW)]
        rows.append((text[a : a + WINDOW], [(s - a, min(e - a, WINDOW), k) for s, e, k in near]))
    some = [text[a : a + WINDOW] for a in rng.integers(0, max(1, len(text) - WINDOW), plain).tolist()]
    return rows, [t for t in some if not _SIGN.search(t)]


def lessons(found: list[tuple[str, list]], bare: list[str], rng: np.random.Generator, planted: int, plain: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: the found ones, `planted` bare ones with an invented span put in, and `plain` bare ones as they are."""
    rows = [tagged(*x) for x in found]
    for _ in range(planted if bare else 0):
        t = bare[int(rng.integers(0, len(bare)))]
        s, kind = invented(rng)
        at = t.find(" ", int(rng.integers(0, max(1, len(t) - len(s)))))
        if at < 0 or at + 1 + len(s) > WINDOW:
            continue
        rows.append(tagged((t[: at + 1] + s + t[at:])[:WINDOW], [(at + 1, at + 1 + len(s), kind)]))
    rows += [tagged(bare[i], []) for i in rng.permutation(len(bare))[:plain]]
    return np.array([r[0] for r in rows]).reshape(-1, WINDOW), np.array([r[1] for r in rows]).reshape(-1, WINDOW)


def train(found: list[tuple[str, list]], bare: list[str], planted: int = 1600, epochs: int = 8, batch: int = 64, seed: int = 11) -> dict[str, np.ndarray]:
    """The network's arrays after `epochs` of Adam over lessons(). Without windows: an untrained network that marks nothing."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    net.p["bias"][0] = 3
    x, y = lessons(found, bare, rng, planted)
    m, v = ({k: np.zeros_like(net.p[k]) for k in Net.NAMES} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            _, g = net.gradients(x[order[i : i + batch]], y[order[i : i + batch]])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            step += 1
            for k in Net.NAMES:
                d = g[k] * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                net.p[k] = (net.p[k] - 0.01 * (0.75**epoch) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net.p


def windows(text: str) -> list[int]:
    """Starts of the windows to decode: those of the regular grid that hold a digit or an @.

    Every kind of span holds one, so the windows left out can hold none.
    """
    at = set()
    for m in _SIGN.finditer(text):
        at.update(range(max(0, (m.start() - WINDOW) // STRIDE + 1), (m.end() - 1) // STRIDE + 1))
    return sorted(k * STRIDE for k in at)


def reconcile(found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """Of spans (start, end, kind) with their summed weights, those that don't overlap and weigh most together."""
    spans = sorted(found, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    best, took = [0.0], []
    for i, s in enumerate(spans):
        j = bisect.bisect_right(ends, s[0], 0, i)
        with_it = best[j] + found[s]
        took.append((with_it > best[-1], j))
        best.append(max(best[-1], with_it))
    out, i = [], len(spans)
    while i:
        yes, j = took[i - 1]
        if yes:
            out.append(spans[i - 1])
        i = j if yes else i - 1
    return out[::-1]


def model_spans(texts: list[str], net: Net, chunk: int = CHUNK) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in each text: all windows are decoded, then each text's spans are reconciled.

    A span that every window cuts is decoded again in windows twice as wide, and so on, until one holds it.
    """
    jobs = [(i, a, -1) for i, t in enumerate(texts) for a in windows(t)]
    found: list[dict] = [{} for _ in texts]
    grid, width = {(i, a) for i, a, _ in jobs}, WINDOW
    while jobs and width <= chunk * WINDOW:
        cut, many = [], chunk * WINDOW // width
        for n in range(0, len(jobs), many):
            some = jobs[n : n + many]
            tags, sure = net.decode(np.stack([codes(texts[i][a : a + width], width) for i, a, _ in some]))
            for (i, a, of), row, p in zip(some, tags, sure, strict=True):
                t = texts[i]
                last = min(width, len(t) - a)
                for s in np.flatnonzero(row[:last] % 2 == 1).tolist():
                    e, kind = s + 1, (int(row[s]) - 1) // 2
                    while e < last and row[e] == row[s] + 1:
                        e += 1
                    # a span that a window cuts on its left is left to the window before; a wider window is asked for one span
                    if (s == 0 and a > 0) or (of >= 0 and not (s <= of < e and 2 * e >= width)):
                        continue
                    if e == width and a + e < len(t):
                        # the next window is asked first if it holds the start
                        if (of >= 0 or s <= STRIDE or (i, a + STRIDE) not in grid) and unfinished(kind, t[a + s : a + e], t[a + s - 1 : a + s]):
                            cut.append((i, a, s))
                    elif p[s:e].mean() >= SURE and (of < 0 or plausible(kind, t[a + s : a + e])):
                        key = (a + s, a + e, kind)
                        found[i][key] = found[i].get(key, 0) + float(p[s:e].sum())
        jobs, width = cut, 2 * width
    return [reconcile(f) for f in found]


def all_spans(texts: list[str], net: Net) -> list[tuple[list, list]]:
    """Pattern spans of each text, and those the network adds: they pass their kind's test and touch no pattern span."""
    out = []
    for text, more in zip(texts, model_spans(texts, net), strict=True):
        base = base_spans(text)
        starts, reach = [s[0] for s in base], [0, *itertools.accumulate((s[1] for s in base), max)]
        added = [s for s in more if plausible(s[2], text[s[0] : s[1]]) and reach[bisect.bisect_left(starts, s[1])] <= s[0]]
        out.append((base, added))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def fit(docs: DataFrame, n_docs: int = 800, places: int = 8, plain: int = 4) -> dict[str, np.ndarray]:
    """The network, trained on windows of about n_docs texts with a digit or an @: pattern spans are the labels, beside invented ones.

    Of each text, `places` windows around its digits and @ and `plain` bare ones are drawn where the text is, from all
    of it; so at most n_docs * (places + plain) windows come to the driver, however long the texts are. Null texts are
    left out; of repeated rows one counts.
    """
    rows = docs.where(F.col("text").rlike("[0-9@]")).select(F.lit(1).alias("k"), F.col("doc_id").alias("id"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(drawn(v.as_py(), places, plain)) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["w"])

    found, bare = [], []
    for r in mapped(bounded_sample(rows, "k", ["id", "t"], n_docs).select("t").distinct(), run, "w string").orderBy("w").toLocalIterator():
        some, more = json.loads(r.w)
        found += [(t, [tuple(s) for s in spans]) for t, spans in some]
        bare += more
    return train(found, bare)


def find(docs: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """One row for each row of docs with its counts of pattern spans, their digest, and all spans.

    Null text counts as empty: no spans, the digest of an empty string. Whole texts are searched, in time linear in
    their length; what the model adds is shorter than CHUNK / 2 * WINDOW characters. A batch of texts and CHUNK windows, or as
    many characters in wider ones, are in memory at a time. Repeated rows give repeated results; columns beside doc_id and text are not read; an empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(shared.value)
        for batch in batches:
            found = all_spans([v.as_py() or "" for v in batch.column(1)], net)
            counts = [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(b + a) for b, a in found], pa.string()), pa.array([len(a) for _, a in found], pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), run, SCHEMA)


def without(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each run of overlapping spans replaced by the kind of its first, then longest, span.

    What stands before a span may be a pattern's match of its own once the span is gone, so the patterns are asked again.
    """
    while spans:
        out, at, end = [], 0, -1
        for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
            if a >= end:
                out += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = end = max(b, end)
        text = "".join([*out, text[at:]])
        spans = base_spans(text)
    return text


def redact(docs: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """docs with each span of `text` replaced by its kind in angle brackets; overlapping spans are replaced as one.

    Null stays null, other columns stay as they are, whatever their names; repeated rows stay repeated; an empty table
    gives an empty one.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(params), docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net(shared.value)
        for batch in batches:
            texts = [v.as_py() for v in batch.column(place)]
            found = all_spans([t or "" for t in texts], net)
            new = [None if t is None else without(t, b + a) for t, (b, a) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return mapped(docs, run, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by patterns and a network trained on them: see find()."""
    docs = read(spark, sf_dir, "documents")
    return find(docs, fit(docs))
