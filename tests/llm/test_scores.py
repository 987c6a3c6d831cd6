import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest

from spanlake.llm import perplexity as px, personal_data as pd_, quality_classifier as qc


def corpus():
    rng = random.Random(2)
    syllables = "an be ta ri lo mus ne ko si da".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    line = lambda: " ".join(word() for _ in range(rng.randint(6, 14))).capitalize() + "."
    good = lambda: "\n".join(line() for _ in range(rng.randint(6, 12)))
    docs = [(i, good(), "xx" if i % 4 else None, "s") for i in range(160)]
    bad = [lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in good().split()), lambda: (word() + " ") * 90]
    return docs + [(200 + i, bad[i % 3](), "xx", "s") for i in range(45)]


def plain_kneser_ney(texts):
    """log p(last class | three before it) straight from the definition."""
    grams = Counter()
    for t in texts:
        raw = re.sub(rb"[ \t\n\x0b\x0c\r]+", b" ", t.encode())
        c = [0, 0, 0] + [int(px.CLASS[b]) for b in raw] + [0]
        if c[3] == 0:
            del c[3]
        if len(c) > 4 and c[-1] == c[-2] == 0:
            c.pop()
        grams.update(tuple(c[i:i + 4]) for i in range(len(c) - 3))
    counts = {4: grams}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k in counts:
        n = [sum(v == i for v in counts[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        discounts[k] = [0] + [max(0.0, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[1] else 0.5 * i for i in (1, 2, 3)]
    contexts = defaultdict(list)
    for k in counts:
        for g, v in counts[k].items():
            contexts[k, g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / 64
        k, values = len(g), contexts.get((len(g), g[:-1]))
        if not values:
            return p(g[1:])
        d, c = discounts[k], counts[k].get(g, 0)
        return ((c - d[min(c, 3)] if c else 0) + sum(d[min(v, 3)] for v in values) * p(g[1:])) / sum(values)
    return lambda g: log(p(g))


def unpacked(code):
    return tuple(int(code) >> 6 * i & 63 for i in (3, 2, 1, 0))


def test_model_is_modified_kneser_ney(spark, documents):
    docs = [(1, "ana banana bandana", "a", "s"), (2, "nab a ban. Ana", "a", "s"), (3, "x" * 40, "b", "s")]
    frame = documents(docs)
    found = px.arrays(px.model(px.counted(frame, px.Rules())))
    for lang, texts in (("a", [docs[0][1], docs[1][1]]), ("b", [docs[2][1]])):
        want = plain_kneser_ney(texts)
        for t in [*texts, "zebra banan 77"]:  # the last has n-grams that the model has not seen
            codes = px.codes(t.encode())
            assert np.allclose(found[lang].score(codes), [want(unpacked(c)) for c in codes], atol=1e-5)


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for l in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", l):
            dup += l in lines
            lines.add(l)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a b c a b c", "a a a a a", "x\nx\n\n\ny # é z\x1cq", "l 1\nl 2\nl 1\r\nl 1\n l 1", "😀 <b> 100% |", "a b c d a b c e " * 30])
def test_counts(text):
    assert px.counts_of(text) == plain_counts(text)


def test_quality_rules(spark, documents):
    docs = corpus() + [(300, None, None, None), (301, "", "xx", "s"), (302, "short one", "zz", "s"), (None, corpus()[1][1], "xx", "s"), (5, corpus()[5][1], "xx", "s")]
    rows = px.quality_rules(documents(docs).selectExpr("*", "1 as n_words", "'x' as log_ppl")).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    for d, text, *_ in docs:
        assert tuple(by[d][c] for c in px.COUNTS) == plain_counts(text)
        n, *_, again = plain_counts(text)
        assert by[d].base_failed == (n < 50 or 100 * again > 50 * n) and not (by[d].kept and by[d].base_failed)
    good = [by[d].kept for d in range(160) if not by[d].base_failed]
    marked = [by[d].kept for d in range(200, 245) if not by[d].base_failed]
    assert sum(good) >= 0.97 * len(good) and sum(marked) <= 0.2 * len(marked) and len(marked) > 10
    assert px.quality_rules(documents([])).count() == 0


def test_shared_triples_equal_a_plain_count(spark, documents):
    docs = [(i, t, "a", "s") for i, t in enumerate(["one two three four", "x one two three  y", "one two three four", "four\u00a0x two", None, "", "ä ö ü ä ö ü", "zz\tä ö\nü"])]
    grams = lambda t: {tuple(w[i:i + 3]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i in range(len(w) - 2)}
    for piece in (1, 1 << 20):
        found = {r.text_key: r for r in px.shared_triples(documents(docs), 3, px.Rules(piece=piece)).collect()}
        assert len(found) == 5
        for i, text, *_ in docs:
            if text:
                others = set().union(*[grams(t) for j, t, *_ in docs if j != i])
                row = found[px.text_key(text.encode())]
                assert (row.n_triples, row.n_shared) == (len(grams(text)), len(grams(text) & others)), text


def test_texts_with_shuffled_words_are_rejected(spark, documents):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 8))) for _ in range(2000)]
    follow = {w: rng.choices(words, k=4) for w in words}

    def text():
        out = [rng.choice(words)]
        while len(out) < 150:
            out.append(rng.choice(follow[out[-1]]))
        return out
    texts = [text() for _ in range(300)]
    docs = [(i, " ".join(t), "xx", "s") for i, t in enumerate(texts)] + [(1000 + i, " ".join(rng.sample(t, len(t))), "xx", "s") for i, t in enumerate(texts[:30])]
    kept = {r.doc_id: r.kept for r in px.quality_rules(documents(docs), px.Rules(below=1e3, above=1e3)).collect()}  # perplexity rejects none
    assert sum(kept[i] for i in range(300)) >= 0.97 * 300 and sum(kept[1000 + i] for i in range(30)) <= 0.2 * 30


def test_classifier_on_held_out_rows(spark, documents):
    docs = corpus()
    labels = [(d, int(d < 200), 0) for d, *_ in docs if d % 5 != 1] + [(9999, 1, 0), (None, 1, 0), (3, None, 0), (4, 7, 0)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    extra = [(400, None), (401, ""), (402, "one"), (None, docs[0][1]), (7, docs[7][1])]
    rows = qc.quality_scores(documents(docs + extra).selectExpr("*", "1 as quality", "2 as score"), frame).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d, *_ in docs + extra if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    right = [r.predicted == (r.doc_id < 200) for r in held if r.doc_id < 400]
    assert sum(right) >= 0.9 * len(right)


def test_held_out_labels_teach_nothing(spark, documents):
    docs = corpus()[::3]
    known = [(d, int(d < 200)) for d, *_ in docs if zlib.crc32(str(d).encode()) % 5]
    secret = [(d, 0) for d, *_ in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    score = lambda rows: sorted((r.doc_id, round(r.score, 9)) for r in qc.quality_scores(documents(docs), spark.createDataFrame(rows, "doc_id bigint, quality int")).collect())
    assert score(known) == score(known + secret)
    assert {r.score for r in qc.quality_scores(documents(docs), spark.createDataFrame([], "doc_id bigint, quality int")).collect()} == {0.5}


def plain_spans(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in zip(pd_.KINDS, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and pd_.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = [None, "", "a@b.c@d.e x@y", "..@a-b.cc, é@x.yz joe.doe+1@mail.example.org.", "1.2.3.4.5 256.1.1.1 001.002.003.255 1.2.3", "4111 1111 1111 1111 22", "4111-1111-1111-1111",
       "+1 (415) 555-0132 +49 30 1234567 2024 12 31 99", "+" + "1" * 9 + " 5", "9" * 60 + "@", "a@b" * 500, "@@@ @. a@.b", "😀 +44 20 7946 0958 😀 10.0.0.1", "x@y.z\n1.2.3.4\n" * 300]


def test_personal_data(spark, documents):
    rng = random.Random(8)
    docs = [(i, t, "xx", "s") for i, t in enumerate(ODD)]
    docs += [(100 + i, " ".join(rng.choice(["word", "7", "10.1.2.3", "bob@ex.org", "4111 1111 1111 1111", "+1 415 555 0100", "12.5", "+7", "5500 0000 0000 0004"]) for _ in range(25)), "xx", "s") for i in range(40)]
    rows = {r.doc_id: r for r in pd_.personal_data(documents(docs).selectExpr("*", "1 as n_email", "2 as spans")).collect()}
    assert len(rows) == len(docs)
    for d, text, *_ in docs:
        want = plain_spans(text)
        r = rows[d]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [r[f"n_{k}"] for k in pd_.KINDS] == [sum(w.startswith(k) for w in want) for k in pd_.KINDS]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert set(want) <= {":".join(s) for s in spans}
        added = [(int(a), int(b)) for k, a, b in spans if f"{k}:{a}:{b}" not in want]
        taken = [tuple(map(int, w.split(":")[1:])) for w in want]
        assert all(b <= x or a >= y for a, b in added for x, y in taken) and all(0 <= a < b <= len(text) for a, b in added)
    assert pd_.personal_data(documents([])).count() == 0


def test_field_gradient_against_differences():
    p = pd_.SpanField()
    text = "call +1 415 555 0132 or 4111 1111 1111 1111 22 now"
    tokens = next(pd_.stretches(text, p))
    lattice, gold = pd_.Lattice(text, tokens, p), pd_.gold_segments(tokens, pd_.base_spans(text))
    rng = np.random.default_rng(0)
    w, move = rng.normal(size=(5, pd_.N_FEATURES)) * 0.1, rng.normal(size=(5, 5)) * 0.1

    def likelihood(w, move):
        """By enumerating every segmentation."""
        spans, single = lattice.scores(w)
        by = defaultdict(list)
        for k, (i, j) in enumerate(lattice.spans):
            by[i] += [(j, t, spans[k, t - 1]) for t in range(1, 5)]
        totals, wanted = [], {(i, j): k + 1 for i, j, k in gold}
        value = {(0, 0): [0.0]}

        def total(i, y):
            if i == lattice.n:
                return 0.0
            options = [(i + 1, 0, single[i]), *by[i]]
            return np.logaddexp.reduce([move[y, t] + s + memo(j, t) for j, t, s in options])
        cache = {}
        def memo(i, y):
            if (i, y) not in cache:
                cache[i, y] = total(i, y)
            return cache[i, y]
        i, y, score = 0, 0, 0.0
        while i < lattice.n:
            nxt = next(((j, k + 1) for a, j, k in gold if a == i), (i + 1, 0))
            s = single[i] if nxt[1] == 0 else spans[lattice.spans.index((i, nxt[0])), nxt[1] - 1]
            score, i, y = score + move[y, nxt[1]] + s, nxt[0], nxt[1]
        return score - memo(0, 0)
    gw, gm = lattice.gradient(gold, w, move)
    for t, f in [(0, 0), (4, 0), (3, 60), (4, 67), (3, 5)]:
        step = np.zeros_like(w)
        step[t, f] = 1e-5
        assert abs((likelihood(w + step, move) - likelihood(w - step, move)) / 2e-5 - gw[t, f]) < 1e-4
    step = np.zeros_like(move)
    step[0, 4] = 1e-5
    assert abs((likelihood(w, move + step) - likelihood(w, move - step)) / 2e-5 - gm[0, 4]) < 1e-4


def test_numbers_beside_found_addresses_are_asked():
    rng, p = random.Random(12), pd_.SpanField()
    card = lambda: rng.choice(["4111111111111111", "4111 1111 1111 1111", "5500 0000 0000 0004", "5500000000000004"])
    w, move = pd_.train([f"word paid {card()} on day {rng.randint(1, 9)} from 10.0.{rng.randint(0, 9)}.{rng.randint(0, 255)} by bob{i}@ex.org or +1 415 555 {rng.randint(1000, 9999)} end" for i in range(200)], p)
    found = lambda text: pd_.field_spans(text, pd_.base_spans(text), w, move, p)
    assert found("login 10.0.0.1 4111111111111111 ok") == [(2, 15, 31)]
    assert found("card 4111 1111 1111 1111 10.0.0.1 ok") == [(2, 5, 24)]
    assert found("login 10.0.0.1 ok") == found("paid 4111 1111 1111 1111, login 10.0.0.1 ok") == []
