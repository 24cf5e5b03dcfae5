import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(x)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(x) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(x) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=3000, deadline=None)
@given(st.text(st.sampled_from("12 0.@-+()a.b%1é"), max_size=40))
def test_patterns_are_the_stated_ones(text):
    assert pii.base_spans(text) == brute(text)


def test_windows_are_drawn_from_the_whole_text():
    text = ("plain words without any sign at all " * 20 + "call +1 (300) 555-1000 now ") * 200
    found, bare = pii.drawn(text, 50, 20)
    assert len(found) == 50 and bare and pii.drawn(text, 50, 20) == (found, bare)
    at = [text.find(w) for w, _ in found]
    assert all(a >= 0 for a in at) and all(w[a:b].startswith("+1") for w, s in found for a, b, _ in s)
    assert pii.drawn("", 5, 5) == ([], [""] * 5) and pii.drawn("1", 5, 0) == ([("1", [])], [])


def test_very_many_digits():
    for text in ("0" * 5000 + ".1.1.1", "1" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "7"):
        assert pii.base_spans(text) == ([(0, len(text), 1)] if text[0] != "1" or text[1] == "." else [])
    assert pii.at_most_255("0" * 9000) and pii.at_most_255("0255") and not pii.at_most_255("256")


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1(" * 70_000, "@" * 200_000):
        pii.base_spans(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = pii.Net.fresh(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = pii.tagged("mail a.b@c.de now 10.0.0.1", [(5, 13, 0), (18, 26, 1)])
    x, y = x[None, :30], y[None, :30]
    _, grads = net.gradients(x, y)
    for k in pii.Net.NAMES:
        flat = net.p[k].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old, eps = flat[i], 1e-4
            flat[i] = old + eps
            up = net.gradients(x, y)[0]
            flat[i] = old - eps
            down = net.gradients(x, y)[0]
            flat[i] = old
            assert abs((up - down) / (2 * eps) - grads[k].reshape(-1)[i]) < 2e-2 * max(1, abs(grads[k].reshape(-1)[i])), k


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(1)
    net = pii.Net.fresh(rng)
    ids = rng.integers(1, 99, (2, 4))
    tags, _ = net.decode(ids)
    em, _ = net.emissions(ids)
    trans = net.p["trans"] + pii.Net.allowed()
    grid = np.stack(np.meshgrid(*[range(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    for b in range(2):
        s = sum(em[t, b][grid[:, t]] for t in range(4)) + sum(trans[grid[:, t], grid[:, t + 1]] for t in range(3))
        s = s + np.where((grid[:, 0] > 0) & (grid[:, 0] % 2 == 0), -1e4, 0)
        assert grid[s.argmax()].tolist() == tags[b].tolist()


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 8), st.integers(1, 5), st.integers(0, 3)), st.integers(1, 20), max_size=8))
def test_reconciling_takes_the_heaviest_set(found):
    spans = {(a, a + n, k): float(w) for (a, n, k), w in found.items()}
    keys, best = list(spans), 0.0
    for mask in range(1 << len(keys)):
        some = sorted(keys[i] for i in range(len(keys)) if mask >> i & 1)
        if all(x[1] <= y[0] for x, y in zip(some, some[1:], strict=False)):
            best = max(best, sum(spans[s] for s in some))
    got = sorted(pii.reconcile(spans))
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False)) and sum(spans[s] for s in got) == best


def test_windows_hold_every_sign():
    text = "x" * 500 + "7" * 130 + "y" * 500 + "@"
    w = pii.windows(text)
    for i, c in enumerate(text):
        if c in "7@":
            assert any(a <= i < a + pii.WINDOW for a in w)
    assert pii.windows("no sign here " * 50) == []


class Marked:
    """Stands for a network: marks an address from each % to before the next ;, and like a network nothing whose beginning it doesn't see."""

    def decode(self, ids):
        tags = np.zeros(ids.shape, np.int64)
        for row, out in zip(ids, tags, strict=True):
            for s in np.flatnonzero(row == pii.code("%")):
                ends = np.flatnonzero((row[s:] == pii.code(";")) | (row[s:] == 0))
                out[s : s + (ends[0] if len(ends) else len(row))] = 2
                out[s] = 1
        return tags, np.ones(ids.shape)


@pytest.mark.parametrize("n", [40, 90, 96, 130, 300, 1000, 5000])
def test_added_spans_of_any_length_at_any_place(n):
    address = ("%name.other @ " + "mail.department." * n)[: n - 3] + "org"
    texts = [";" * lead + address + ";" + " 7 words " * 30 for lead in range(0, 150, 7)] + [";" * 60 + address]
    assert [added for _, added in pii.all_spans(texts, Marked())] == [[(t.index("%"), t.index("%") + n, 0)] for t in texts]


def test_marks_without_an_end_take_linear_time():
    for t in ("%a1" * 100_000 + " @", "%1 " * 100_000, ("%" + " " * 300 + "1") * 1000):
        asked = []
        net = Marked()
        net.decode = lambda ids, f=Marked().decode: asked.append(ids.size) or f(ids)
        pii.model_spans([t], net)
        assert sum(asked) <= 8 * pii.WINDOW * (len(t) // pii.STRIDE + 2)


def test_trained_network_adds_spellings_and_leaves_prose():
    prose = ["plain words in a row that say nothing much at all and go on for a while without end " * 4 + f"call +1 ({300 + i}) 555-{1000 + i} or mail ab.{10 + i}@mail{i % 9}.example.com end" for i in range(60)]
    parts = [pii.drawn(t, 8, 4) for t in prose]
    found, bare = [w for f, _ in parts for w in f], [t for _, b in parts for t in b]
    net = pii.Net(pii.train(found, bare, planted=1600, epochs=6))
    added = [len(a) for _, a in pii.all_spans(["nothing to see in these words at all", "version 2.0 of the 3rd text"], net)]
    assert added == [0, 0]
    rng = np.random.default_rng(9)
    x, y = pii.lessons(found, bare, rng, 300)
    tags, _ = net.decode(x)
    assert (tags == y)[y > 0].mean() > 0.85


def test_redaction(spark):
    d = spark.createDataFrame([(1, "a x.y@z.com b 10.0.0.1"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(d, pii.train([], [])).collect()}
    assert got == {1: "a <EMAIL> b <IP>", 2: None}


def test_redaction_of_overlapping_spans(spark):
    texts = {
        "call +15551234567 12john.doe@mail.com now": "call <PHONE> now",
        "host 10.0.0.0 4111 1111 1111 1111 end": "host <IP> end",
        # a card only once the address behind it is gone
        "pay 4111 1111 1111 1111 10.0.0.0 end": "pay <CARD> <IP> end",
    }
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in pii.redact(d, pii.train([], [])).orderBy("doc_id").collect()] == list(texts.values())


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(["+15551234567", "12john.doe@mail.com", "10.0.0.0", "4111 1111 1111 1111", " ", "-", "a", "1"]), max_size=8).map("".join))
def test_redaction_leaves_no_pattern_span(text):
    new = pii.without(text, pii.base_spans(text))
    assert pii.base_spans(new) == [] and re.sub("<[A-Z]+>", "", new).count("@") <= text.count("@")


def test_query(spark):
    from quillgraph.llm import registry

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in registry.QUERIES["op3_pii"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = brute(r.text)
        assert [getattr(got[r.doc_id], f"n_{k}") for k in pii.KINDS] == [sum(s[2] == i for s in base) for i in range(4)]
        assert set(pii.joined(base).split(",")) <= set(got[r.doc_id].spans.split(",")) | {""}
