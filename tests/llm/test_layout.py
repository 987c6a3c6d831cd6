import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from spanlake.llm import mixing as mx, packing as pk, revisits as rv, token_rollup as tr


def test_boundaries_are_optimal():
    rng = random.Random(4)

    def padding(lengths, counts, ends):
        return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 6)
        ends = pk.optimal_boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for r in range(min(k, len(lengths))) for c in combinations(lengths[:-1], r))
        assert len(ends) <= k and ends == sorted(set(ends)) and padding(lengths, counts, ends) == best
    assert pk.optimal_boundaries([], [], 4) == []


def test_packed_sequences_hold_every_word_once(spark, documents):
    rng = random.Random(6)
    docs = [(i, " é\n".join(f"w{k}" for k in range(rng.randint(1, 45)))) for i in range(80)] + [(200, None), (201, ""), (202, " \n"), (None, "a b"), (3, "again"), (3, "again"), (300, "z " * 500)]
    p = pk.Packing(longest=20, buckets=4, budget=64)
    rows = pk.packed(documents(docs).selectExpr("*", "1 as length", "2 as bucket"), p, with_text=True).collect()
    words = Counter(w for _, t in docs for w in (t or "").split())
    assert Counter(w for r in rows for w in r.text.split()) == words
    text = dict((d, t) for d, t in docs)
    assert all(len(r.text.split()) == r.length <= r.padded and (r.doc_id == 3 or r.text == text[r.doc_id][r.begin:r.end]) for r in rows)
    per = defaultdict(list)
    for r in rows:
        per[r.bucket, r.batch].append((r.slot, r.padded))
    for (bucket, batch), seats in per.items():
        assert sorted(s for s, _ in seats) == list(range(len(seats))) and len({x for _, x in seats}) == 1
        room = max(1, 64 // seats[0][1])
        assert len(seats) <= room and (len(seats) == room or batch == max(b for k, b in per if k == bucket))
    assert pk.packed(documents([]), p).count() == 0


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    weight = {k: weights[i % 3] for i, k in enumerate(sorted(sizes))}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] >= 2 * sizes[k]}
        for k in full or open_:
            out[k] = 2 * sizes[k] if full else level * weight[k]
        left -= sum(out[k] for k in full)
        open_ = open_ - full if full else set()
    return out


def test_mix_takes_what_targets_say(spark, documents):
    rng = random.Random(9)
    names = ["b", "a", "ä", "hot", None, "tiny", ""]
    docs = [(i, " ".join("w" * rng.randint(1, 120)), "en", rng.choice(names[:5] + ["hot"] * 4)) for i in range(600)]
    docs += [(700, "one", "en", "tiny"), (701, None, "en", "void"), (702, "", "en", "a"), (None, "x y z", "en", "a"), (3, "x y z", "en", "a"), (3, "x y z", "en", "a"), (703, "q r", "en", "")]
    df = documents(docs).selectExpr("*", "1 as size", "2 as target")
    rows = mx.mixed(df).collect()
    assert len(rows) == len(docs) and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mx.mixed(df.repartition(5)).collect()), key=repr)
    sizes = Counter()
    for _, t, _, s in docs:
        sizes["~" if s is None else s] += len((t or "").split())  # the missing source comes last
    want = {k: v for k, v in plain_targets(sizes).items()}
    taken, seen = Counter(), {}
    key = {(r.source_size): r for r in rows}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert {(v, round(want[k], 6)) for k, v in sizes.items()} == set(taken)
    assert all(abs(t - target) <= max(64, 0.02 * target) for (_, target), t in taken.items())
    again = mx.mixture(df)
    assert again.columns == df.columns and max(Counter(r.doc_id for r in again.collect() if r.doc_id not in (3, None)).values()) <= 2
    assert mx.mixed(documents([])).count() == 0 and mx.mixture(documents([])).count() == 0


def test_slots_of_a_source_are_evenly_spread(spark, documents):
    docs = [(i, "w " * 50, "en", "ab"[i % 3 == 0]) for i in range(300)]
    rows, goals, block = mx.sized(documents(docs))
    slots = [r.source_key for r in mx.schedule(goals, block).orderBy("slot").collect()]
    share = Counter(slots)["sa"] / len(slots)
    for n in range(20, len(slots), 37):
        assert abs(Counter(slots[:n])["sa"] - share * n) <= 3


RECORD = "record_id bigint, url string, at bigint, status int, headers map<string,string>, base_id int"


def test_revisits_as_a_plain_scan(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        url = rng.choice(["http://A.org/x", "https://www.a.org:443/x/#f", "a.org/x?utm_source=q", "http://b.org/?b=2&a=1", "http://b.org?a=1&b=2"] + ["http://hot.org"] * 5)
        tag, time = rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "mon", "tue"])
        rows.append((i, url, rng.randrange(150), rng.choice([200, 304]), {k: v for k, v in (("ETag", tag), ("Last-Modified", time), ("X", str(i)), ("Content-Length", str(i))) if v}, 1))
    rows += [(900, None, 5, 304, None, 1), (901, "", 5, 304, {}, 1), (902, "http://hot.org", None, 304, {}, 1), (903, "http://never.org", 9, 304, {"etag": "x"}, 1), (904, "http://hot.org", 77, 404, {}, 1), rows[0], rows[1]]
    canon = {"http://A.org/x": "a.org/x", "https://www.a.org:443/x/#f": "a.org/x", "a.org/x?utm_source=q": "a.org/x", "http://b.org/?b=2&a=1": "b.org?a=1&b=2", "http://b.org?a=1&b=2": "b.org?a=1&b=2", "http://hot.org": "hot.org", "http://never.org": "never.org"}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    want = []
    for i, url, at, status, own, _ in rows:
        if status != 304:
            continue
        key = canon.get(url)
        fits = [r for r in rows if r[3] == 200 and key and at is not None and canon[r[1]] == key and r[2] < at]
        base = max(fits, key=lambda r: (r[2], r[0])) if fits else None
        own, b = low(own), low(base[4]) if base else {}
        weak = lambda x: x and x.removeprefix("W/")
        if not base:
            outcome = "no-base"
        elif not own.get("etag") and not own.get("last-modified"):
            outcome = "unverified"
        elif (weak(own["etag"]) == weak(b.get("etag"))) if own.get("etag") else own["last-modified"] == b.get("last-modified"):
            outcome = "merged"
        else:
            outcome = "mismatch"
        want.append((i, key, at, base and base[0], outcome, {**b, **{k: v for k, v in own.items() if k not in rv.KEPT_FIELDS}} if outcome == "merged" else None))
    got = [tuple(r) for r in rv.resolve(spark.createDataFrame(rows, RECORD)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {w[4] for w in want} == {"merged", "mismatch", "unverified", "no-base"}
    assert rv.resolve(spark.createDataFrame([], RECORD)).count() == 0


CHANGE = "kind string, source string, lang string, tokenizer string, tokens bigint, old_tokens bigint"


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rng = random.Random(1)
    store = tr.TokenTotals(spark, str(tmp_path / "totals"))
    assert store.totals().count() == 0
    totals = defaultdict(lambda: [0, 0])
    for n in range(4):
        rows = [(rng.choice(["insert", "delete", "revise", "odd", None]), rng.choice(["a", None, ""]), rng.choice(["en", "de"]), "v1", rng.choice([None, 5, 9]), rng.choice([None, 2, 7])) for _ in range(60)]
        for kind, s, l, v, new, old in rows:
            sign = {"insert": (1, new or 0), "delete": (-1, -(old or 0)), "revise": (0, (new or 0) - (old or 0))}.get(kind, (0, 0))
            totals[s, l, v][0] += sign[0]
            totals[s, l, v][1] += sign[1]
        assert store.apply(f"b{n}", spark.createDataFrame(rows, CHANGE))
        assert not store.apply(f"b{n}", spark.createDataFrame(rows[:7], CHANGE))
    (tmp_path / "totals" / "batch=broken").mkdir()  # an attempt that did not end
    got = {(r.source, r.lang, r.tokenizer): [r.documents, r.tokens] for r in store.totals().collect()}
    assert got == {k: v for k, v in totals.items() if v != [0, 0]}
    with pytest.raises(ValueError):
        store.apply("../x", spark.createDataFrame([], CHANGE))


def test_token_counts(spark, documents):
    docs = [(1, "Hello world, it's 42!"), (2, None), (3, ""), (None, "a  b")]
    got = {(r.doc_id, r.tokenizer): r.tokens for r in tr.token_counts(documents(docs).selectExpr("*", "1 as counts"), ["words", "byte_bpe_50k"]).collect()}
    assert got[1, "words"] == 4 and got[2, "words"] == got[3, "byte_bpe_50k"] == 0 and got[None, "words"] == 2
    assert got[1, "byte_bpe_50k"] == len(["Hello", " world", ",", " it", "'s", " 42", "!"])


@pytest.mark.parametrize("share", [1.5, 0.05])
def test_small_sources_reach_their_targets_beside_large_blocks(spark, documents, share):
    rng = random.Random(13)
    docs = [(i, "w " * 100, "en", f"small{i % 40:02d}") for i in range(120)] + [(1000 + i, "w " * rng.randint(300, 900), "en", "hot") for i in range(400)]
    mix = mx.Mix(share=share, smallest=3576)
    rows = mx.mixed(documents(docs), mix).selectExpr("case when doc_id < 1000 then doc_id % 40 else -1 end as s", "*").collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.s] += r.taken
        target[r.s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(target) == 41 and all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert any(t < 600 for t in target.values()) == (share < 1)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 4096, 99_991, 1 << 21])
def test_steps_visit_every_place_evenly(n):
    g = mx.step(n) if n > 1 else 1
    places = [i * g % n for i in range(min(n, 200_000))]
    assert len(set(places)) == len(places)
    for share in (0.1, 0.37, 0.8):
        seen = 0
        for i, x in enumerate(places, 1):
            seen += x < round(share * n)
            assert abs(seen - i * round(share * n) / n) <= 5
