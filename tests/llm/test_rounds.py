"""Periodic runs, line dedup and the audit of filters against brute force; with null, empty, tied, repeated, long and clashing rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarrymill.llm import interactions, lines, queries, runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def key(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Clashing columns, nulls, repeated rows, long texts, shared lines, copies."""
    random.seed(11)
    shared = ["  A line that Many documents share\t", "a line that many DOCUMENTS share", "Été à la plage, vingt", "short one", "\x0b", "x" * 19, "y" * 20, "é" * 19, "é" * 20]
    rows = [(i, "\n".join(random.choice(shared) if random.random() < 0.5 else f"own line of {i} {random.random()}" for _ in range(random.randint(0, 9))), random.choice(["en", "de", None]), 1, 1, 1, "k") for i in range(60)]
    rows += [(i, "a b c d e f g h i j k l m " * i, "en", 0, 0, 0, None) for i in range(100, 110)]
    rows += [(3, None, None, None, None, None, None), (None, None, None, None, None, None, None), (None, "y" * 20 + "\n" + "own", None, 1, 1, 1, "c"), (5, "", "", 0, 0, 0, ""), (7, "TWICE", "en", 1, 1, 1, "c"), (7, "TWICE", "en", 1, 1, 1, "c"), (8, "TWICE", "de", 1, 1, 1, "c"), (200, "word " * 60_000, "en", 1, 1, 1, "c"), (201, "\n".join(f"{k % 700} a line of the long text" for k in range(20_000)), "en", 1, 1, 1, "c"), (202, "€ " * 30 + "$ % A B", "en", 1, 1, 1, "c"), (203, "\r\n \t\n\x1c\n", "en", 1, 1, 1, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part int, mask int, a int, o string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(df):
    return df.sparkSession.createDataFrame([], df.schema)


def brute_runs(w, least=24, times=3):
    """By definition: for each period and start of a maximal stretch, tried from the least period on."""
    found, n = {}, len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                stretch = w[i : j + p]
                smallest = next(q for q in range(1, p + 1) if all(a == b for a, b in zip(stretch, stretch[q:])))
                if smallest == p:
                    found[i, j + p - i, p] = True
            i = max(j, i + 1)
    return sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=8), st.sampled_from([(24, 3), (6, 3), (2, 2), (9, 2), (3, 3), (40, 4)]))
def test_runs_are_those_of_the_definition(blocks, how):
    w = [x for block, n in blocks for x in block * n]
    got = runs.runs(np.array(w, np.int32), *how)
    assert got == brute_runs(w, *how)


def test_names_and_agreement():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 2, 300).astype(np.int32)
    levels = runs.names(w)
    for k, level in enumerate(levels):
        windows = [tuple(w[i : i + (1 << k)]) for i in range(len(w) - (1 << k) + 1)]
        assert len(level) == len(windows) and len(set(zip(windows, level.tolist()))) == len(set(windows)) == len(set(level.tolist()))
    a, b = rng.integers(0, 150, 500), rng.integers(150, 300, 500)
    for back in (False, True):
        for x, y, got in zip(a.tolist(), b.tolist(), runs.agreement(levels, a, b, back).tolist()):
            want = 0
            while (x - want > 0 and w[x - want - 1] == w[y - want - 1]) if back else (y + want < 300 and w[x + want] == w[y + want]):
                want += 1
            assert got == want


def brute_op11(rows):
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
        found = brute_runs([ids[x] for x in w]) if n < 3000 else runs.runs(np.array([ids[x] for x in w]))
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        milli = best and 1000 * best[1] // best[2]
        out.append((doc, len(found), *(best or (None,) * 3), milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return key(out)


def test_op11(spark, odd, docs):
    for df in (docs, odd, empty(odd)):
        got = runs.digests(runs.periodic_runs(runs.planted(df)))
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert key(tuple(r) for r in got.collect()) == brute_op11([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count() and sum(r.n_runs > 0 for r in got.values()) > len(got) / 30


def test_op11_long_texts():
    """Half a million equal words, and a text whose every third repeats: one run each, in seconds."""
    began = time.time()
    assert runs.runs(np.zeros(500_000, np.int32)) == [(0, 500_000, 1)]
    block = np.random.default_rng(1).integers(0, 50_000, 100_000).astype(np.int32)
    assert (0, 300_000, 100_000) in runs.runs(np.tile(block, 3))
    assert time.time() - began < 60


def test_strongest_takes_the_first_of_equal_ones():
    assert runs.strongest([(0, 30, 10), (5, 24, 8), (40, 60, 15), (90, 40, 10)]) == (40, 60, 15)
    assert runs.strongest([]) is None


def brute_op12(rows, least_chars=20, least_docs=3):
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    of = lambda line: line.strip(strip).translate(lower)
    holds = defaultdict(set)
    low = -(1 << 63)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(of(line)) >= least_chars:
                holds[of(line)].add(low if doc is None else doc)
    last = {k: max(v) for k, v in holds.items() if len(v) >= least_docs}
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if of(x) not in last or last[of(x)] == (low if doc is None else doc)]
        out.append((doc, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return key(out)


def op12_rows(df):
    return key((r.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in lines.line_dedup(df).collect())


def test_op12(odd, docs):
    for df in (odd, docs, empty(odd)):
        want = brute_op12([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert op12_rows(df) == want
        assert not want or any(r[2] for r in want)


def test_op12_lines_of_the_last_document_stay(spark):
    same = "The Same Line Everywhere"
    df = spark.createDataFrame([(1, same), (2, f" {same.lower()}\t\nown\n{same.upper()}"), (9, f"{same}\n\n{same}"), (9, same), (4, "only twice, this line is\n"), (5, "only twice, this line is")], "doc_id long, text string")
    got = {(r.doc_id, r.n_lines): (r.n_dropped, r.kept) for r in lines.line_dedup(df).collect()}
    assert got == {(1, 1): (1, ""), (2, 3): (2, "own"), (9, 3): (0, f"{same}\n\n{same}"), (9, 1): (0, same), (4, 2): (0, "only twice, this line is\n"), (5, 1): (0, "only twice, this line is")}


def brute_op13(rows, labels):
    low, quality, toxic = {}, set(), set()
    for doc, text, _ in rows:
        if doc is not None:
            low[text or ""] = min(low.get(text or "", doc), doc)
    for doc, q, t in labels:
        (quality.add(doc) if q == 1 and doc is not None else None, toxic.add(doc) if t == 1 and doc is not None else None)
    fails, part = [], []
    for doc, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and low[t] < doc}
        fails.append({f for f in own if own[f]})
        part.append(lang or "")
    out, removed_by = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for p in set(part):
            left = [k for k in range(len(rows)) if part[k] == p]
            every = list(left)
            for step, f in enumerate(order):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                out[p, order, step + 1] = [len(left), len(gone), sum(f in fails[k] for k in every) - len(gone), sum(fails[k] == {f} for k in every), sum(rows[k][0] in quality for k in gone), sum(rows[k][0] in toxic for k in gone)]
                removed_by[p, f] += len(gone)
    return key((*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.mark.parametrize("few", [True, False])
def test_op13(spark, odd, docs, few, monkeypatch):
    if not few:
        monkeypatch.setattr(interactions, "BROADCAST_IDS", 0)
        monkeypatch.setattr(interactions, "PARTS", 2)
    own = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, 1, 1), (None, 1, 1), (9, None, None), (105, 0, 1)], "doc_id long, quality int, toxic int")
    for df, labels in ((odd, own), (docs, spark.read.parquet(f"{SF}/labels.parquet")), (odd, empty(own))):
        rows = [(r.doc_id, r.text, r.lang) for r in df.select("doc_id", "text", "lang").collect()]
        got = interactions.audited(df, labels)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert key(tuple(r) for r in got.collect()) == brute_op13(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert interactions.audited(empty(odd), own).count() == 0


def test_first_failures():
    table = interactions.first_failures(5)
    assert table.shape == (32, 120)
    for mask in range(32):
        for k, order in enumerate(permutations(range(5))):
            assert table[mask, k] == next((s for s, f in enumerate(order) if mask >> f & 1), 5)


def test_new_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for q in ("op12_line_dedup", "op13_filter_interactions"):
        got, want = queries.QUERIES[q](spark, SF), con.execute(queries.ORACLES[q])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert key(tuple(r) for r in got.select(*names).collect()) == key(want.fetchall())


def test_op5_whole_mailboxes_and_names():
    from quarrymill.llm import surrogates

    texts = {"Dr 王小明欧阳修好人": "王小明欧阳修好人", "to müller@example.com now": "müller", "(o'brien@example.com)": "o'brien", "<иван@пример.рф>": "иван", 'by "john doe"@example.org.': "john doe", "'anna@example.com'": "anna", "email=karl@example.com": "karl"}
    for text, secret in texts.items():
        found, new = surrogates.replaced(text, b"k", {})
        assert len(found) == 1 and secret not in new and not any(part in new for part in secret.split() if len(part) > 3), (text, new)
    assert surrogates.replaced("email=karl@example.com, karl@example.com", b"k", {})[1].count(surrogates.replaced("karl@example.com", b"k", {})[1]) == 2
    new = surrogates.replaced("<иван@пример.рф>", b"k", {})[1]
    assert new.endswith(".рф>") and all(surrogates.unicodedata.name(c).startswith("CYRILLIC") for c in new if c.isalpha())


def test_op5_names_of_one_surrogate(spark):
    """Hundreds of given names that get one of twenty at first: all distinct in the end, none an entity, the first of each kept."""
    from quarrymill.llm import surrogates

    names = [f"x{surrogates.SYLLABLES['latin'][k % 20]}{surrogates.SYLLABLES['latin'][k // 20]}o" for k in range(400)] + ["anna", "karl"]
    got = surrogates.settled(spark.createDataFrame([("given", n, "") for n in names], "kind string, value string, gender string"), b"key").collect()
    made = {r.value: surrogates.surrogate(b"key", "given", r.value, r.attempt, r.gender) for r in got}
    assert len(made) == len(names) == len(set(made.values())) and not set(made.values()) & set(names)
    first = {}
    for n in sorted(names):
        first.setdefault(surrogates.surrogate(b"key", "given", n, 0), n)
    assert {r.value for r in got if r.attempt == 0} == {n for new, n in first.items() if new not in names}
