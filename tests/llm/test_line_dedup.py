import random

import xxhash

from spanlake.llm.line_dedup import BASE, MODULUS, chunks, line_dedup, passage_dedup


def java_hash(value):
    data = value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True)
    h = xxhash.xxh64_intdigest(data, seed=42)
    return h - (1 << 64) if h >> 63 else h


def plain_chunks(text, window=2):
    lines = text.split("\n")
    h = [java_hash(x) & ((1 << 31) - 1) for x in lines]
    rolled = []
    for i in range(len(h)):
        if i < window - 1:
            rolled.append(None)
            continue
        v = 0
        for back in range(window):
            v = (v * BASE + h[i - back]) % MODULUS
        rolled.append(java_hash(v))
    top = (1 << 63) - 1
    at = lambda i: rolled[i] if 0 <= i < len(lines) and rolled[i] is not None else top
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (rolled[i] is not None and rolled[i] < at(i - 1) and rolled[i] < at(i + 1)):
            out.append("\n".join(lines[start:i + 1]))
            start = i + 1
    return out


def plain_dedup(docs):
    """Chunks of several lines first, then lines of more than 50 words in what is left."""
    seen = {}
    for d, text in docs:
        parts = plain_chunks(text) if text is not None else []
        for c in [*parts, *(x for p in parts for x in p.split("\n"))]:
            if ("\n" in c and c.strip(" \t\n\r\x0b\x0c") and c in parts) or ("\n" not in c and len(c.split()) > 50):
                seen.setdefault(c, []).append(d)
        for c in parts:  # a chunk that is one long line was met twice
            if "\n" not in c and c in seen:
                seen[c].pop()
    out = []
    for d, text in docs:
        if text is None:
            out.append((d, None, 0))
            continue
        cut = 0

        def thinned(parts):
            nonlocal cut
            left, had = [], set()
            for c in parts:
                ids = [x for x in seen.get(c, []) if x is not None]
                again = len(seen.get(c, [])) > 1 and d is not None and (d != min(ids) or c in had)
                had.add(c)
                cut += again
                if not again:
                    left.append(c)
            return left

        lines = thinned([x for c in thinned(plain_chunks(text)) for x in c.split("\n")])
        out.append((d, "\n".join(lines) if cut else text, cut))
    return out


def corpus():
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("alpha beta gamma delta omega tau é rho".split()) for _ in range(rng.randint(3, 9))) + str(rng.random())
    shared = [line() for _ in range(14)]
    docs = []
    for d in range(30):
        own = [line() for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(own))
        docs.append((d, "\n".join(own[:at] + (shared if d % 3 == 0 else []) + own[at:])))
    long = [" ".join(f"{k}-{i}" for i in range(n)) for k, n in (("p", 51), ("q", 50), ("r", 300))]
    docs += [(d, "\n".join([line(), long[d % 3], line()])) for d in range(60, 69)] + [(70, long[0]), (71, long[0] + "\n" + long[0]), (72, long[1])]
    docs += [(40, "\n".join(shared)), (41, docs[1][1]), (42, docs[1][1] + "\n" + docs[1][1]), (43, None), (44, ""), (45, "\n\n\n"), (46, "\n\n\n"), (47, "a\n" * 500), (None, docs[4][1]), (4, docs[4][1])]
    return docs


def test_chunks_join_to_the_text_and_match_a_plain_version(spark, documents):
    docs = corpus()
    got = {(r.doc_id, "\n".join(r.chunks)): r.chunks for r in chunks(documents(docs), ["doc_id"]).collect() if r.chunks}
    for d, text in docs:
        if text is not None:
            assert got[d, text] == plain_chunks(text)


def test_same_rows_as_a_plain_version(spark, documents):
    docs = corpus()
    got = line_dedup(documents(docs)).select("doc_id", "text", "n_removed").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2])
    assert sorted(map(tuple, got), key=key) == sorted(plain_dedup(docs), key=key)
    assert sum(r.n_removed for r in got) > 20


def test_boundaries_do_not_shift_with_inserted_lines():
    lines = next(t for d, t in corpus() if d == 40).split("\n")
    before, after = plain_chunks("\n".join(lines)), plain_chunks("\n".join(["something new", *lines]))
    assert set(before[2:]) <= set(after)


def test_extra_columns_stay_and_clashing_ones_are_replaced(spark, documents):
    df = documents([(1, "x\ny\nz"), (2, "x\ny\nz")]).selectExpr("*", "7 as n_removed", "'k' as chunk", "1 as _doc_count", "array('q') as l")
    rows = {r.doc_id: r for r in line_dedup(df).collect()}
    assert rows[1].text == "x\ny\nz" and rows[1].n_removed == 0 and rows[1].chunk == "k" and rows[1].l == ["q"]
    assert rows[2].n_removed >= 1


def test_empty_table(spark, documents):
    assert line_dedup(documents([])).count() == 0


def plain_runs(lines):
    """First and last line and text of the shortest run of more than 50 words from each line that has words."""
    worded = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
    for i, s in enumerate(worded):
        n = 0
        for j in range(i, len(worded)):
            n += len(lines[worded[j]].split())
            if n > 50:
                yield s, worded[j], "\n".join(lines[k] for k in worded[i:j + 1])
                break


def plain_passages(docs):
    """Documents without the chunks that ``plain_dedup`` compares and without all lines of a run that came before."""
    seen = {}
    for d, text in docs:
        for c in ([c for c in plain_chunks(text) if "\n" in c and c.strip(" \t\n\r\x0b\x0c")] + [("run", r) for *_, r in plain_runs(text.split("\n"))] if text is not None else []):
            seen.setdefault(c, []).append(d)
    first = {c: min(x for x in ds if x is not None) for c, ds in seen.items() if len(ds) > 1 and any(x is not None for x in ds)}
    out = []
    for d, text in docs:
        if text is None or d is None:
            out.append((d, text, 0))
            continue
        parts, lines, stay = plain_chunks(text), text.split("\n"), []
        for j, c in enumerate(parts):
            keep = c not in first or (first[c] == d and parts.index(c) == j)
            stay += [keep] * (c.count("\n") + 1)
        ends = {}
        for s, e, r in plain_runs(lines):
            if ("run", r) in first and (first["run", r] != d or ends.setdefault(r, e) < s):
                stay[s:e + 1] = [False] * (e + 1 - s)
        out.append((d, "\n".join(x for x, keep in zip(lines, stay) if keep), len(stay) - sum(stay)))
    return out


def test_passages_of_few_lines_leave_nothing_behind(spark, documents):
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    docs, own = [], {}
    for k in range(60):
        shared = [line(30) for _ in range(3)] if k % 2 else [line(20), "", line(20), line(12)]
        for d in (2 * k, 2 * k + 1):
            own[d] = [line(12) for _ in range(6)]
            docs.append((d, "\n".join(own[d][:3] + shared + own[d][3:])))
    rows = {r.doc_id: r for r in passage_dedup(documents(docs)).collect()}
    for d, text in docs:
        assert rows[d].text == (text if d % 2 == 0 else "\n".join(own[d]))
        assert (rows[d].n_removed > 0) == (d % 2 == 1)


def test_passages_as_a_plain_version(spark, documents):
    docs = corpus() + [(80, "b c\n" * 120), (81, "\n".join(f"{i} x y" for i in range(20)) + "\n\nown\n" + "\n".join(f"{i} x y" for i in range(20)))]
    got = passage_dedup(documents(docs)).select("doc_id", "text", "n_removed").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2])
    assert sorted(map(tuple, got), key=key) == sorted(plain_passages(docs), key=key)
    assert passage_dedup(documents([])).count() == 0
