"""N-gram join, vector codes and the audit of sources, on small tables against plain Python and DuckDB."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from test_operators import ROWS, WORDS, documents, near, prose

from quaero.llm import departures, divergence, ngram_join, vector_codes
from quaero.llm.near_dedup import Shingler

WS = re.compile(r"[\x20\x09-\x0D]+")


# ---------------------------------------------------------------- n-gram join


def shingles(text, size):
    w = [x for x in WS.split(re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(rows, size, percent):
    """Brute force: (doc_id, n_shingles, component_id) of every row."""
    sets = [shingles(text, size) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    first = {}
    for i, row in enumerate(rows):
        first.setdefault(find(i), []).append(row[0])
    named = {k: min((x for x in v if x is not None), default=None) for k, v in first.items()}
    return Counter((row[0], len(s), named[find(i)]) for i, (row, s) in enumerate(zip(rows, sets, strict=True)))


def joined(spark, rows, size=3, percent=90):
    got = ngram_join.ngram_components(documents(spark, rows), size, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(tuple(r) for r in got.collect())


def templates(n, edits, seed=3, words=300):
    """Texts that are each edits words away from one base, and from one another by twice as many."""
    r, base = random.Random(seed), prose(words, seed).split(" ")
    out = []
    for k in range(n):
        w = base[:]
        for i in r.sample(range(words), edits):
            w[i] = f"own{k}"
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark):
    rows = [*ROWS, (20, "x" * 2_000_000), (21, "x" * 2_000_000 + " y"), (None, prose(300, 1)), (22, "a b"), (23, "A  b"), (24, "a c")]
    assert joined(spark, rows) == components(rows, 3, 90)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_of_groups_that_barely_link(spark, size, percent):
    rows = list(enumerate([*templates(12, 2, 4), *templates(12, 4, 5), *templates(12, 1, 6, 60), *(prose(n, n) for n in range(3, 40, 3))]))
    rows += [(1000 + i, near(prose(300, 4), k, i)) for i, k in enumerate([1, 2, 3, 4, 6])]
    assert joined(spark, rows, size, percent) == components(rows, size, percent)


def test_large_keys_are_dealt_anew(spark, monkeypatch):
    """With tasks of few members all else goes by differences, and nothing is lost."""
    rows = list(enumerate([*templates(16, 3, 4), *templates(12, 5, 5), near(prose(300, 4), 1, 9), prose(300, 4)]))
    want = components(rows, 3, 90)
    assert len({c for _, _, c in want}) > 2
    monkeypatch.setattr(ngram_join, "MEET", 4)
    assert joined(spark, rows) == want


def test_templates_that_do_not_link_make_no_pairs(spark, monkeypatch):
    """Rows that go to tasks grow as the texts do, though all of them share most of their text."""
    sent = []
    monkeypatch.setattr(ngram_join, "MEET", 32)
    for name in ("_with_centre", "_among"):
        whole = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda rows, *a, whole=whole: sent.append(rows.count()) or whole(rows, *a))
    counts = []
    for n in (150, 300):
        sent.clear()
        got = joined(spark, list(enumerate(templates(n, 5))))
        assert len(got) == n
        counts.append(sum(sent))
    assert counts[1] <= 2.6 * counts[0] + 100, counts


def test_join_of_small_keys_makes_no_table_of_sets(spark, monkeypatch):
    """Sets go from the texts to where they are compared, also those of repeated rows and of a centre with several groups of partners."""
    monkeypatch.setattr(departures, "PAIR_GROUP", 2)
    monkeypatch.setattr(ngram_join, "DEALT", 3000)
    monkeypatch.setattr(ngram_join, "full_sets", lambda *a: pytest.fail("a table of sets"))
    base = prose(300, 4)
    rows = [(i, near(base, k, i)) for i, k in enumerate([0, 1, 2, 3, 4, 6, 1, 2])]
    rows += [rows[0], rows[0], rows[3], *((20 + i, t) for i, t in enumerate(templates(12, 2, 4)))]
    assert joined(spark, rows) == components(rows, 3, 90)


@pytest.mark.parametrize("held", [7, 100, 1 << 20])
@pytest.mark.parametrize("size", [1, 3, 5])
def test_sets_of_a_column_are_those_of_its_texts(monkeypatch, size, held):
    """Whatever is hashed at once: the same sets as one text at a time, each spelling hashed once."""
    monkeypatch.setattr(ngram_join, "HELD", held)
    texts = [*(row[1] for row in ROWS), None, "", " \x0b\r\n ", "  a\x0b\x0cB \r\n c\x1c\u00c9 d ", "a b", "A  b", "a b a b a b a b", "x " * 5000, "\u00c4\u00e4 \u2003 K \u212a k"]
    want = [Shingler(size).shingles(x if x is None else x.encode()) for x in texts]
    for column in (pa.array(texts, pa.string()), pa.array(["z", *texts], pa.large_string()).slice(1)):
        got = list(ngram_join.text_sets(column, size))
        assert len(got) == len(want) and all(x.dtype == y.dtype and np.array_equal(x, y) for x, y in zip(got, want, strict=True))
    assert [len(x) for x in want] == [len(shingles(x, size)) for x in texts]
    packed = [zstandard.compress((x or "").encode()) for x in texts]
    assert all(map(np.array_equal, ngram_join.packed_sets(size)(packed), want))
    hashed, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: hashed.append(w) or digest(w))
    monkeypatch.setattr(ngram_join, "HELD", 1 << 20)
    list(ngram_join.text_sets(pa.array(["a b c", "A b d"] * 50), size))
    assert sorted(hashed) == [b"a", b"b", b"c", b"d"]


def test_join_sends_less_than_sets_and_no_table_of_keys(spark, monkeypatch):
    """What goes to tasks that compare sets is smaller than those sets, and the keys of the prefixes are moved but not written."""
    sent, labels = [], []
    among, at_centre, written = ngram_join._among, departures._at_centre, ngram_join.Scratch.written

    def seen(rows, name, node):
        sent.append(rows.agg(F.sum(F.length(name)), F.count(F.when(F.col(node) >= 0, 1))).first())
        return rows

    monkeypatch.setattr(ngram_join, "_among", lambda rows, *a: among(seen(rows, rows.columns[-1], "id"), *a))
    monkeypatch.setattr(departures, "_at_centre", lambda rows, *a: at_centre(seen(rows, rows.columns[-1], "grp"), *a))
    monkeypatch.setattr(ngram_join.Scratch, "written", lambda self, df, label: labels.append(label) or written(self, df, label))
    rows = [(i, near(prose(300, 4), k, i)) for i, k in enumerate([0, 1, 2, 3, 4, 6, 1, 2])] + [(20 + i, t) for i, t in enumerate(templates(12, 2, 4))]
    assert joined(spark, rows) == components(rows, 3, 90)
    n = sum(m for _, m in sent)
    assert len(sent) >= 2 and n > 20
    assert sum(b for b, _ in sent) < 0.6 * 8 * 290 * n, sent
    assert "keys" not in labels[: labels.index("members")] and "centres" not in labels


def test_linked_members_have_a_departure_key_in_common(spark):
    """Groups around a base: whatever is linked is joined by certain links, or meets under a key."""
    r, percent, rows, sets = random.Random(2), 90, [], {}
    common = {}
    for grp in range(12):
        base = r.sample(range(1, 400), 120)
        common[grp] = set(base) if grp % 3 else set()
        for i in range(12):
            sets[grp * 100 + i] = {*r.sample(base, 120 - r.randint(0, 9)), *r.sample(range(400, 440), r.randint(0, 9))}
            mine = sets[grp * 100 + i]
            rows.append((grp, grp * 100 + i, len(mine), [*sorted(mine - common[grp]), *sorted(common[grp] - mine)]))
    links, keys = ngram_join.dealt_anew(spark.createDataFrame(rows, "grp long, id long, n long, away array<long>"), percent, ngram_join.Scratch(spark))
    certain, of = Counter(), {}
    for a, b in links.collect():
        assert 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        certain[a] += 1
        certain[b] += 1
    for key, i in keys.collect():
        of.setdefault(i, set()).add(key)
    met = 0
    for i, j in itertools.combinations(sets, 2):
        if i // 100 == j // 100 and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and not (certain[i] and certain[j]):
            met += 1
            assert of[i] & of[j], (i, j)
    assert met


def test_prefixes_of_linked_sets_meet_under_every_order():
    r, tables = random.Random(3), [np.array([random.Random(i).randint(0, 3) for i in range(64)], np.uint8).repeat((1 << ngram_join.SKETCH_LOG2) // 64)] * 2
    for _ in range(200):
        both = [r.getrandbits(64) for _ in range(r.randint(9, 200))]
        k = len(both) // 19
        a, b = (np.array(sorted({*both, *(r.getrandbits(64) for _ in range(k))}), np.uint64) for _ in range(2))
        if 100 * len(both) >= 90 * (2 * k + len(both)):
            for x, y in zip(ngram_join.prefixes(a, tables, 90), ngram_join.prefixes(b, tables, 90), strict=True):
                assert set(x.tolist()) & set(y.tolist())
    assert [ngram_join.prefix_length(n, 90) for n in (9, 10, 11, 20, 21, 300)] == [1, 2, 2, 3, 3, 31]


def test_join_of_an_empty_table(spark):
    assert not joined(spark, [])
    assert joined(spark, [(1, None), (1, None), (None, "")]) == Counter({(1, 0, 1): 2, (None, 0, None): 1})


# ---------------------------------------------------------------- vector codes


def coded(rows):
    """Brute force with Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    ints = [[math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    size = width // 4
    parts = [[v[p * size : (p + 1) * size] for v in ints] for p in range(4)]
    start = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:256]
    books = [[parts[p][i] for i in start] for p in range(4)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))
    for _ in range(4):
        at = [[nearest(p, x)[1] for x in parts[p]] for p in range(4)]
        for p in range(4):
            for i in set(at[p]):
                mine = [x for x, j in zip(parts[p], at[p]) if j == i]
                books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(p, parts[p][k]) for p in range(4)] for k in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    of = Counter()
    for (_, _, lab), e in zip(kept, errors):
        of[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    return Counter((i, "".join("%02x" % j for _, j in f), fits(e), fits(of[lab]), digest) for (i, _, lab), f, e in zip(kept, found, errors))


def table_of(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string")
    return df.repartition(3)


def vectors(n, width, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [[float(x) for x in row] for row in (r.normal(size=(n, width)) * spread).astype(np.float32)]


@pytest.mark.parametrize("spread", [0.1, 3e4, 1e12])
def test_codes_equal_brute_force(spark, spread):
    """The three arithmetics: floats, 64-bit and Python's integers."""
    rows = [(i * 3 % 331, v, i % 3 if i % 4 else None) for i, v in enumerate(vectors(320, 8, 1, spread))]
    rows += [(None, rows[0][1], 1), (5, None, 1), (6, [1.0, None, *[0.0] * 6], 2), (7, [float("nan")] * 8, 2), (8, [math.inf] * 8, 2), (9, rows[1][1], 0), (9, rows[1][1], 0)]
    got = vector_codes.vector_codes(table_of(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == coded(rows)


def test_codes_of_few_equal_and_uneven_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [], None)], [(1, [0.5] * 4, 1)] * 3, [(2, [1.0] * 5, 1), (1, [1.0], 2), (3, [-0.0004, 0.0, 2.0], 2)], [(i, [1.0, 0.0, 0.0, 0.0], 1) for i in range(300)]):
        assert Counter(tuple(r) for r in vector_codes.vector_codes(table_of(spark, rows)).collect()) == coded(rows)


def test_annulus_finds_the_lowest_of_equally_near_entries():
    r = random.Random(4)
    for kind in ("float64", "int64", "object"):
        for n in (1, 2, 17, 256):
            entries = [[r.randint(-6, 6) for _ in range(3)] for _ in range(n)]
            entries[n // 2] = entries[0]
            parts = np.array([[r.randint(-9, 9) for _ in range(3)] for _ in range(400)])
            at, far = vector_codes.Codebook(entries, kind).nearest(parts)
            want = [min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(entries)) for p in parts.tolist()]
            assert [(int(d), int(i)) for d, i in zip(far, at)] == want


# ---------------------------------------------------------------- audit of sources


def audit_rows():
    r = random.Random(8)
    rows = []
    for i in range(160):
        words = r.choices(WORDS[:60], k=r.randint(1, 80))
        rows.append((" ".join(words).title() + " 12 don't é漢 Éa", r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "ß", "z😀", None, *(f"t{k}" for k in range(9))])))
    rows += [(None, "en", "s1"), ("", "fr", "only"), (None, "xx", "p"), ("123 !", "xx", "q"), ("b " * 40_000 + "a" * 300_000, "en", "s1")]
    return rows * 2


@pytest.mark.parametrize(("min_docs", "slice_terms"), [(30, 8192), (2, 7), (1, 50), (10_000, 10)])
def test_audit_equals_sql(spark, min_docs, slice_terms):
    rows = audit_rows()
    names = "text string, lang string, source string, term string, n long, grp long, rank int, value long"
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], names)
    got = divergence.divergence(docs, min_docs=min_docs, top=5, slice_terms=slice_terms)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
    cols = ["lang", "source", "part", "item", "value", "rank"]
    assert got.columns == cols
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({divergence.sql(min_docs, 5)})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 50


def test_audit_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_each_pair_of_blocks_meets_once(spark):
    for n in (1, 2, 5, 6):
        vectors_ = spark.createDataFrame([("en", 0, b, n, b, 0, 0, b"") for b in range(n)], "lang string, slice long, block long, blocks long, grp long, n_terms long, rest long, vector binary")
        languages = vectors_.filter("block = 0").drop("block", "grp")
        rows = divergence._rounds(vectors_, languages).collect()
        met = [(r["home"], r["grp"]) for r in rows if r["round"] >= 0]
        assert sorted(tuple(sorted(m)) for m in met) == list(itertools.combinations(range(n), 2))
        assert Counter(r["home"] for r in rows if r["round"] == -2) == Counter(range(n))
        for r in range(n):  # a block is in one meeting of a round at most
            busy = [x for row in rows if row["round"] == r for x in (row["home"], row["grp"])]
            assert len(busy) == len(set(busy))


def test_probabilities_are_exact():
    r = random.Random(6)
    for _ in range(500):
        total, v = r.randint(0, 10**15), r.randint(1, 10**12)
        n = r.randint(0, total)
        assert int(divergence.probability(np.array([n]), total, v)[0]) == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_terms_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    text = ("Ab cdé 12x_y" * 50).encode()
    whole = [w for some in divergence.terms(text) for w in some]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [w for some in divergence.terms(text) for w in some] == whole == [x.encode() for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.decode().lower())]
