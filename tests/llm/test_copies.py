import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanlake.llm import exact_dedup as ex, periodic_runs as pr, queries, spelling_variants as sv


# --- periodic runs -----------------------------------------------------------------

def plain_runs(w, least=6, periods=4):
    """Every stretch of equal words one period apart; of several periods of one stretch the smallest."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, periods * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(3)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.randrange(5) for _ in range(rng.randint(1, 9))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (unit * rng.randint(3, 8))[:rng.randint(3, 60)]
        yield w


def test_runs_as_plain_scan():
    import numpy as np
    for w in sequences():
        for rule in (pr.Repeats(), pr.Repeats(least=12, periods=5)):
            assert pr.runs_of(np.array(w, np.int64), rule) == plain_runs(w, rule.least, rule.periods), w
    with pytest.raises(ValueError):
        pr.Repeats(periods=3)


def test_runs_of_long_texts(spark, documents):
    unit = [f"w{i}" for i in range(1000)]
    texts = ["a " * 200_000, " ".join(unit * 150), " ".join(f"v{i}" for i in range(100_000))]
    rows = {r.doc_id: r for r in pr.periodic_runs(documents(list(enumerate(texts)))).collect()}
    assert [tuple(x) for x in rows[0].runs] == [(0, 200_000, 1)] and rows[0].collapsed == "a"
    assert [tuple(x) for x in rows[1].runs] == [(0, 150_000, 1000)] and rows[1].collapsed == " ".join(unit)
    assert rows[2].runs == [] and rows[2].collapsed == texts[2]


def planted(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def mixed_texts():
    rng = random.Random(8)
    out = [(i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(str(x) for x in w)) for i, w in zip(range(300), sequences())]
    return out + [(400, None), (401, ""), (402, " \n"), (None, "b b b b b b b"), (5, out[5][1]), (403, "é é " * 9), (404, "x y " * 300)]


def test_query_of_periodic_runs(spark, documents, tmp_path):
    rows = mixed_texts()
    documents(rows).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc, text in rows:
        w = planted(doc, text)
        runs = plain_runs(w)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                     digest(" ".join(x for i, x in enumerate(w) if i not in dropped))))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert queries.op11_periodic_runs(spark, str(tmp_path)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert pr.periodic_runs(documents([])).count() == 0


# --- exact copies ------------------------------------------------------------------

def copies():
    rng = random.Random(2)
    out = [(i, rng.choice(["", "one", "two ", " two", "Two", "é", "é", "long " * 50_000, f"own {i}"])) for i in range(400)]
    return out + [(500 + i, "hot") for i in range(700)] + [(2000, None), (2001, None), (3, "repeated"), (3, "repeated"), (2002, "one"), (None, "none"), (None, "none"), (None, "one")]


def plain_copies(rows, best):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    keep = {t: best([d for d in ds if d is not None], default=None) for t, ds in groups.items()}
    return sorted(((d, keep[t or ""], len(groups[t or ""]), d == keep[t or ""]) for d, t in rows), key=repr)


@pytest.mark.parametrize("m", [ex.Merge(), ex.Merge(runs=5, fan=2, largest=False), ex.Merge(runs=1), ex.Merge(runs=3, fan=2, digest=lambda t: F.left(t, F.lit(1)).cast("binary"))])
def test_exact_groups_as_plain_groups(spark, documents, m):
    rows = copies()
    docs = documents(rows).repartition(7).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("run", F.lit(None).cast("int"))
    got = ex.exact_groups(docs, m)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=repr) == plain_copies(rows, max if m.largest else min)
    stay = ex.exact_deduplicated(docs, m)
    assert stay.columns == docs.columns and Counter(r.text or "" for r in stay.collect()) == Counter({t or "" for _, t in rows})


def test_exact_groups_of_nothing_and_of_text_ids(spark, documents):
    assert ex.exact_groups(documents([])).count() == 0
    named = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "name string, body string")
    assert sorted(map(tuple, ex.exact_groups(named, id="name", text="body").drop("digest").collect())) == [("a", "b", 2, False), ("b", "b", 2, True), ("c", "c", 1, True)]
    with pytest.raises(ValueError):
        ex.Merge(fan=1)


def test_hot_copies_move_as_one_row_a_task(spark, documents):
    rows = ex.tree_merge(spark.range(0, 100_000, 1, 8).select((F.spark_partition_id() % 8).alias("run"), F.lit("d").alias("digest"), "id", F.lit(1).cast("bigint").alias("n")), ["digest"], ex.Merge(runs=8, fan=2))
    assert [tuple(r) for r in rows.collect()] == [("d", 99_999, 100_000)]


def test_exact_copies_run_no_python(spark, documents, tmp_path):
    documents(copies()).write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.op12_exact_copies(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- spelling variants -------------------------------------------------------------

def edits(w, letters):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters if c != b[0]}


def plain_variants(n, ratio=10):
    letters = {c for w in n for c in w}
    near = {w: (edits(w, letters) & n.keys()) - {w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x.encode()), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def vocabulary():
    rng = random.Random(12)
    n = {}
    for _ in range(60):
        w = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(1, 9)))
        n[w] = rng.choice([1, 50, 3000])
        for _ in range(rng.randrange(12)):
            n.setdefault(rng.choice(sorted(edits(w, "abé"))), rng.choice([1, 2, 5, 30, 300]))
    n |= {"a" * 500: 40, "a" * 501: 3, "a" * 499 + "b": 4, "": 2, "x": 20, "𝄞lef": 3, "𝄞le": 50}
    n |= {"k" * i: 10 ** (i - 3) for i in range(4, 16)}  # a long chain of forms
    return n


@pytest.mark.parametrize("symbols", [None, 1, 3, 26])
def test_variants_as_all_edits(spark, symbols):
    n = vocabulary()
    rows = [*n.items(), (None, 3), ("null", None), ("zero", 0)]
    got = sv.variant_groups(spark.createDataFrame(rows, "word string, n bigint").withColumn("code", F.lit(1)).withColumn("form", F.lit(1)), sv.Variants(symbols=symbols))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r)[1:] for r in got.collect()} == plain_variants(n) and got.count() == len(n)


def test_variants_of_nothing(spark):
    assert sv.variant_groups(spark.createDataFrame([], "word string, n bigint")).count() == 0
    with pytest.raises(ValueError):
        sv.Variants(ratio=1)


def test_neighbourhood_has_every_edit():
    import numpy as np
    rng = random.Random(4)
    for _ in range(50):
        w = [rng.randint(1, 3) for _ in range(rng.randint(1, 8))]
        made = set(sv.neighbourhoods(np.array([w], np.uint64), 3)[0].tolist())
        text = "".join(map(str, w))
        assert made == {int(sv.codes(np.array([[int(c) for c in e]], np.uint64).reshape(1, -1))[0]) for e in edits(text, "123") | {text}}


def plain_words(docs):
    n = Counter()
    for doc, text in docs:
        for x in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{doc}:{x}".encode())
            if h % 31 == 0 and doc is not None:
                at = h % len(x)
                x = x[:at] + x[at + 1:]
            n[x] += doc is not None
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def test_query_of_spelling_variants(spark, documents, tmp_path):
    rng = random.Random(9)
    base = ["".join(rng.choice("aeiounrstlÉéß×") for _ in range(rng.randint(5, 12))) for _ in range(80)]
    docs = [(d, " ".join(rng.choice([str, str.upper, str.title])(rng.choice(base[:rng.choice([3, 80])])) for _ in range(60))) for d in range(200)]
    docs += [(300, None), (301, ""), (302, "a" * 1000), (303, "A" * 1000), (304, "don't re-entering 12345678 under_score"), docs[0]]
    documents(docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.word: tuple(r)[1:] for r in queries.op13_spelling_variants(spark, str(tmp_path)).collect()}
    want = plain_variants(plain_words(docs))
    assert got == want and any(v[0] for v in want.values())


def test_variants_of_very_long_words(spark):
    words = [("a" * 100_000, 900), ("a" * 99_999 + "b", 3), ("a" * 100_001, 4), ("a" * 100_002, 5)]
    got = {len(r.word): r for r in sv.variant_groups(spark.createDataFrame(words[:1] + words[2:], "word string, n bigint")).collect()}
    assert got[100_001].form == words[0][0] and got[100_002].form is None and got[100_001].n_near == 2
    got = sv.variant_groups(spark.createDataFrame(words[:2], "word string, n bigint")).where("n = 3").collect()
    assert got[0].root == words[0][0]
