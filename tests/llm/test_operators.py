"""The ten operators on small tables with nulls, empty and repeated rows, against plain Python."""

import base64
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quaero.llm import chat, departures, exact_dedup, mixing, near_dedup, ordinal, piece_tokens, quality_rules, token_store, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id string"
WS = re.compile(r"[\x20\x09-\x0D]+")


def documents(spark, rows):
    """rows of (doc_id, text[, source]) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], "en", (*r, "s")[2], len(r[1] or ""), "x", "y") for r in rows], DOCS)


rng = random.Random(5)
WORDS = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def near(text, edits, seed):
    r, w = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(w)), edits):
        w[i] = "zz%d" % seed
    return " ".join(w)


BASE = prose(300, 1)
ROWS = [(1, "A b\tc"), (2, "Abc"), (3, None), (4, ""), (5, " \n"), (6, "Abc "), (6, "Abc "), (7, BASE), (8, near(BASE, 3, 1)), (9, near(BASE, 3, 2)), (10, near(BASE, 90, 3)),
        (11, prose(30000, 2)), (None, "Abc"), (None, None), (12, "x y\nz"), (13, BASE + " "), (14, "漢字 é 😀 <0x41>"), (15, "one two three")]


@pytest.fixture(scope="module")
def table(spark):
    return documents(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(table, digest_bytes):
    got = exact_dedup.exact_dedup(table, digest_bytes)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in ROWS])
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars"]
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(con.sql(f"SELECT {', '.join(cols)} FROM ({exact_dedup.SQL})").fetchall())


CLASHES = ["_id", "_sign", "_sha", "_chars", "_n", "_t", "_w", "row", "n", "size", "copies", "sign", "n_words", "kept", "component", "_copies", "n_kept", "n_stay", "the_id", "place", "turn", "bad", "_bad", "tokens"]


@pytest.mark.parametrize("stage", [quality_rules.keep_good, exact_dedup.keep_first_copies, near_dedup.keep_one_of_each, mixing.repeat_rows])
def test_stages_keep_columns_with_any_name(spark, stage):
    rows = [(i, prose(200, i).replace(" a", ". A") + ".", f"s{i % 3}") for i in range(30)]
    docs = documents(spark, rows).select("doc_id", "text", "source", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES])
    out = stage(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES)


@pytest.mark.parametrize("group", [1000])
def test_verification_deals_a_large_group(spark, group):
    rows = [(i, "same  text" if i % 2 else "same text") for i in range(group)] + [(5000 + i, f"own {i}") for i in range(50)]
    got = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    assert {r["keep_id"] for r in got if r["doc_id"] < 5000} == {1} and sum(r["kept"] for r in got) == 51
    assert all(r["group_size"] == (group if r["doc_id"] < 5000 else 1) for r in got)


def test_exact_dedup_keeps_the_repeated_row_that_is_first(spark):
    rows = [(1, "ab"), (2, "a b "), (2, "a b "), (None, "x y"), (None, "x y"), (None, "xy"), (None, "other"), (3, "own"), (3, "else")]
    docs = documents(spark, rows)
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(2, "a b "), (None, "x y"), (None, "other"), (3, "own"), (3, "else")])


def test_index_filter_has_no_false_negatives():
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(2000)), np.uint8).reshape(-1, 32)
    assert exact_dedup.bloom_hits(keys, exact_dedup.bloom_build(keys, 1 << 15), 1 << 15).all()
    other = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(2000)), np.uint8).reshape(-1, 32)
    assert exact_dedup.bloom_hits(other, exact_dedup.bloom_build(keys, 1 << 15), 1 << 15).mean() < 0.1


def rule_counts(text):
    w = [x for x in WS.split(text or "") if x]
    seen, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WS.sub("", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    rows = [(i, prose(200, i).replace(" a", ". A") + ".") for i in range(40)] + [(100, "a | b | c | " * 60), (101, None), (102, ""), (103, "x y z " * 40), (104, "u\nu\n\n \nu v"), (None, prose(80, 99) + ".")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    for i, text in rows:
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == rule_counts(text)
        n, _, _, _, rep = rule_counts(text)
        assert got[i]["base_failed"] == (n < 50 or 100 * rep > 50 * n)
    assert all(got[i]["kept"] for i in range(40)) and not any(got[i]["kept"] for i in range(100, 105))


def test_estimate_recovers_planted_rates():
    r = random.Random(3)
    on_bad, on_good, share = (0.9, 0.7, 0.5, 0.4), (0.002, 0.01, 0.03, 0.08), 0.8
    patterns = Counter()
    for _ in range(40000):
        good = r.random() < share
        patterns[tuple((-1 if r.random() < (g if good else b) else 1) if r.random() < 0.9 else 0 for g, b in zip(on_good, on_bad))] += 1
    fit = quality_rules.estimate(dict(patterns))
    assert abs(fit["good"] - share) < 0.02
    assert all(abs(x - y) < 0.03 for x, y in zip(fit["bad_on_bad"] + fit["bad_on_good"], on_bad + on_good))
    p = lambda *votes: quality_rules.posterior(votes, fit["good"], fit["bad_on_good"], fit["bad_on_bad"])
    assert p(1, 1, 1, -1) > 0.9 > 0.5 > p(-1, 1, 1, 1)  # a poor rule's bad vote is outvoted, a good one's is not
    assert p(1, 1, -1, 1) > 0.8 > 0.2 > p(1, -1, -1, -1)


def test_estimate_equals_em_by_hand():
    """The rates are a fixed point: recomputed from the posteriors they stay what they are."""
    r = random.Random(11)
    patterns = Counter(tuple(r.choices((-1, 0, 1), (1, 2, 12), k=5)) if r.random() < 0.7 else tuple(r.choices((-1, 1), (2, 1), k=5)) for _ in range(5000))
    fit = quality_rules.estimate(dict(patterns), rounds=5000)
    chance = {v: quality_rules.posterior(v, fit["good"], fit["bad_on_good"], fit["bad_on_bad"]) for v in patterns}
    assert abs((sum(n * chance[v] for v, n in patterns.items()) + 1) / (5000 + 2) - fit["good"]) < 1e-6
    for j in range(5):
        cast = sum(n * (1 - chance[v]) for v, n in patterns.items() if v[j])
        bad = sum(n * (1 - chance[v]) for v, n in patterns.items() if v[j] < 0)
        assert abs((bad + 1) / (cast + 2) - fit["bad_on_bad"][j]) < 1e-6


def test_mixing(spark):
    rows = [(i, prose(random.Random(i).randint(1, 400), i), f"s{i % 7}" if i % 11 else None) for i in range(1500)] + [(2000, None, "s1"), (2001, "", "s2")] + [(3000, "a b c", "s3")] * 5
    docs = documents(spark, rows)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in sizes if x not in capped) for s in sizes if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = share | {s: 3 * sizes[s] for s in capped}
    for s in sizes:
        mine = got[got["source"].isna() if s is None else got["source"] == s]
        assert abs(mine["target"].iloc[0] - target[s]) < 1e-6 * target[s] and (mine["source_size"] == sizes[s]).all()
        assert abs(mine["taken"].sum() - target[s]) < 0.01 * target[s] + 10
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.repeat_rows(docs).count() == got["copies"].sum()


def fill(doc_id):
    """A null doc_id comes after every other."""
    return (1 << 63) - 1 if doc_id is None else doc_id


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = [x for x in WS.split(w) if x]
        sets.append(set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else {tuple(w)} if w else set())
    low = [fill(r[0]) for r in rows]
    comp = list(low)
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if comp[i] != comp[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return Counter((low[i], len(sets[i]), comp[i]) for i in range(len(rows)))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, size, percent):
    # A base with many variants that are not near each other, short texts around the limits, and the odd rows.
    rows = list(ROWS) + [(100 + i, near(BASE, 6, 10 + i)) for i in range(40)]
    short = prose(12, 77).split(" ")
    rows += [(300 + i, " ".join(short[: 6 + i])) for i in range(6)] + [(400 + i, " ".join(short) + " t%d" % i) for i in range(30)]
    got = near_dedup.near_components(documents(spark, rows), size, percent).collect()
    assert Counter((fill(r["doc_id"]), r["n_shingles"], fill(r["component_id"])) for r in got) == brute_components(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_buckets_of_more_than_one_block(spark, monkeypatch):
    # Blocks of eight: components with blocks of their own, meetings of several blocks, clusters.
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 2000)
    rows = [(i, near(BASE, r, 500 + i)) for i, r in enumerate([4] * 40 + [9] * 40 + [14] * 40)]
    rows += [(200 + i, near(near(BASE, 10, 700 + i % 4), 3, 800 + i)) for i in range(40)]
    got = near_dedup.near_components(documents(spark, rows), 3, 85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 3, 85)


def test_templates_that_do_not_link_send_rows_in_proportion(spark, monkeypatch):
    """Each text is 12 of 300 words away from one base: no pair is linked, many pass the estimate."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    sent = []
    for module, name in ((near_dedup, "_by_task"), (departures, "_with_centre")):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda rows, *a, whole=whole: sent.append(rows.count()) or whole(rows, *a))
    counts = []
    for n in (100, 200):
        sent.clear()
        got = near_dedup.near_components(documents(spark, [(i, near(BASE, 12, i)) for i in range(n)]), 3, 85).collect()
        assert len(got) == n and all(r["kept"] for r in got)
        counts.append(sum(sent))
    assert counts[1] <= 2.2 * counts[0], counts


def test_dealt_buckets_lose_no_link(spark, monkeypatch):
    """Small groups of near copies inside one template, larger than a block: equal to brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    rows = [(i, near(BASE, 12, i)) for i in range(40)]
    rows += [(100 + 10 * i + j, near(near(BASE, 10, 50 + i), 2, 200 + 10 * i + j)) for i in range(8) for j in range(4)]
    rows += [(300 + i, near(BASE, 4, 400 + i)) for i in range(20)]
    got = near_dedup.near_components(documents(spark, rows), 3, 85).collect()
    want = brute_components(rows, 3, 85)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert len({c for _, _, c in want}) > 20


def test_near_dedup_keeps_texts_without_ids_of_their_own_apart(spark):
    far = [prose(200, 900 + i) for i in range(8)]
    rows = [(None, far[0]), (None, far[1]), (None, far[1]), (None, None), (None, " "), (7, far[2]), (7, far[3]), (7, near(far[3], 2, 1)), (8, near(far[2], 2, 2)),
            (9, far[4]), (9, far[4]), (9, far[5]), (10, ""), (10, None), (10, far[6]), (11, near(far[6], 2, 3)), (6, near(far[1], 2, 4))]
    docs = documents(spark, rows)
    got = near_dedup.near_components(docs).collect()
    assert Counter((fill(r["doc_id"]), r["n_shingles"], fill(r["component_id"])) for r in got) == brute_components(rows, 5, 80)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    left = Counter((r["doc_id"], (r["text"] or "").strip()) for r in kept.collect())
    third = [x for x in left if x[1] in (far[3], near(far[3], 2, 1))]
    assert len(third) == 1 and left.pop(third[0]) == 1
    assert left == Counter({(None, far[0]): 1, (6, near(far[1], 2, 4)): 1, (None, ""): 2, (7, far[2]): 1, (9, far[4]): 1, (9, far[5]): 1, (10, ""): 2, (10, far[6]): 1})
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert sum(r["kept"] for r in got if r["doc_id"] is None) == 3  # one far[0] and the two without words


def test_hypermin_estimate():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.r_[a[:3400], r.integers(0, 1 << 63, 600, dtype=np.uint64)])
    est, used = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
    assert abs(est[0] - 3400 / 4600) < 0.2 and used[0] == near_dedup.REGISTERS


def test_piece_tokens_equal_the_library(table):
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = piece_tokens.PieceEncoder(path)
    got = piece_tokens.piece_tokens(table, path).collect()
    assert len(got) == len(ROWS)
    texts = Counter((i, t or "") for i, t in ROWS)
    want = Counter()
    for (i, t), n in texts.items():
        ids = e.library.encode(t) + [e.end_id]
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(e.library.decode(ids).encode()).hexdigest())] += n
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    r = random.Random(9)
    for _ in range(3000):
        x = "".join(r.choice(" ab▁\n\té漢😀<0x41>.the ing  12") for _ in range(r.randint(0, 40)))
        assert e.encode(x) == e.library.encode(x), repr(x)


def test_piece_words_are_encoded_once():
    e = piece_tokens.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    r, seen, join = random.Random(5), Counter(), e.join
    e.join = lambda word: seen.update([word]) or join(word)
    words = ["".join(r.choice("abeth.é漢(1") for _ in range(r.randint(1, 9))) for _ in range(300)]
    for _ in range(50):
        x = " ".join(r.choice(words) for _ in range(60))
        assert e.encode(x) == e.library.encode(x), repr(x)
        x = x.replace("a ", "a  ") + " "
        assert e.encode(x) == e.library.encode(x), repr(x)
    assert {w for w in seen if w.count("▁") == 1 and len(w) > 1} <= {"▁" + w for w in words} and max(n for w, n in seen.items() if w[1:] in words) == 1


def test_letter_ends_are_counted_by_what_is_none(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abé漢😀𝒜1)].,\"”' \n\t#\u0301") for _ in range(r.randint(0, 30)))) for i in range(2000)]
    closing = quality_rules.CLOSING.replace("\\", "")
    want = {i: sum((w.rstrip(closing) or "1")[-1].isalpha() for w in re.findall("[^\x20\x09-\x0d]+", t)) for i, t in rows}
    got = quality_rules.counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: x["n_letter_ends"] for x in got.select("doc_id", "n_letter_ends").collect()} == want


def test_token_store(spark, table):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(token_store.stored_documents(table, path).collect(), key=lambda r: r["start"])
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    e = token_store.WordEncoder(path)
    r = random.Random(4)
    for _ in range(2000):
        x = "".join(r.choice(" a'b's't\n\té漢😀.the İß\x1cΣ12") for _ in range(r.randint(0, 30)))
        assert e.encode([x.encode()])[0] == e.pack(tok.encode(x, add_special_tokens=False).ids), repr(x)


def test_perfect_hash():
    ids, nth = np.arange(-500, 4500) * 7, np.zeros(5000, np.int64)
    mph = token_store.PerfectHash.build(ids, nth)
    assert sorted(mph.slots(ids, nth)) == list(range(5000))
    back, _ = token_store.PerfectHash.frombytes(memoryview(mph.tobytes()))
    assert (back.slots(ids, nth) == mph.slots(ids, nth)).all()


def test_absent_keys_are_turned_away(spark, table):
    path, _ = token_store.write_store(table, public_tokenizers.path("word_bpe_49k.json"))
    keys = spark.range(1000, 3000).selectExpr("id", "0L AS nth")
    assert token_store.look_up(path, keys).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/é x", "<p>" + "hello " * 50), (2, "http://b/", "<p>" + "hello " * 50), (3, None, None), (4, "u", ""), (5, "http://c/", "only"), (5, "http://c/", "only"), (None, "z", "only")]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string")), with_payload=True).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first.setdefault(h or "", i)
            first[h or ""] = min(first[h or ""], i)
    want = Counter()
    used = set()
    for i, _, h in pages:
        p = (h or "").encode()
        reply = first[h or ""] == i and p not in used
        if reply:
            used.add(p)
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if reply else "revisit", None if reply else first[h or ""])] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(bytes(r["payload"]) == b"" for r in got if r["record_type"] == "revisit")


def test_archive_has_dictionary_frame(tmp_path):
    import struct

    f = tmp_path / "x.warc.zst"
    rows = [warc.record(i, f"http://x/{i}", prose(80, i).encode(), "D", None, False) for i in range(300)]
    with f.open("wb") as out:
        w = warc.ArchiveWriter(out, sample_bytes=20_000)
        for r in rows:
            w.add(r)
        w.close()
    assert struct.unpack("<I", f.read_bytes()[:4])[0] == warc.DICT_MAGIC
    with f.open("rb") as src:
        assert list(warc.read_archive(src, block=1000)) == rows


def test_url_rules(spark):
    pages = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}{'' if i % 2 else '.www'}.x.com/{'buy' if i % 3 == 0 else 'read'}/{i}") for i in range(120)]
    odd = [(200, None), (201, "no scheme"), (202, "HTTP://A.Example.NET/en/x?y"), (203, "http://q.example.net"), (204, "https://spam.y.com/buy/1#f"), (205, "http://b.org/fr/"), (206, "x://example.com/de/z")]
    df = spark.createDataFrame([*pages, *odd, odd[0]], "page_id long, url string")
    labelled = spark.createDataFrame([(u, i % 3 == 0) for i, u in pages], "url string, bad boolean")
    got = {r["page_id"]: r for r in url_rules.judge(df, labelled).collect()}
    assert all(got[i]["verdict"] == ("block" if i % 3 == 0 else "allow") for i, _ in pages)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(200, 207)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("q.example.net", "", None, "allow"),
        ("spam.y.com", "/buy/1", None, "block"), ("b.org", "/fr/", "org/fr/", "allow"), ("example.com", "/de/z", "example.com/de/", "block")]


def test_url_rules_equal_brute_force(spark):
    """Every combination of tokens counted, the same tests, the same pruning, every URL against every rule."""
    r = random.Random(21)
    urls = [f"http{r.choice(['', 's'])}://{r.choice('abcd')}.{r.choice(['x', 'y', 'z'])}.com/{r.choice(['buy', 'read', 'p1', 'p22'])}/{i}" for i in range(600)]
    urls += [f"http://rare.site.io/deep/down/{i}" for i in range(6)]  # 1 % of all, bad every time, tokens always together
    is_bad = [("b.y" in u and "buy" in u) or "rare" in u or r.random() < 0.05 for u in urls]
    how = url_rules.Mining()
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("bad", F.lit("clash"))
    labelled = spark.createDataFrame(list(zip(urls, is_bad)), "url string, bad boolean")
    sets = [frozenset(x["t"]) for x in labelled.select(url_rules.tokens(F.col("url")).alias("t")).collect()]
    n, n_bad = len(urls), sum(is_bad)
    seen, bad = Counter(), Counter()
    for s, b in zip(sets, is_bad):
        for k in range(1, len(s) + 1):
            for c in itertools.combinations(sorted(s), k):
                seen[frozenset(c)] += 1
                bad[frozenset(c)] += b
    share = n_bad / n
    sure = {c: bad[c] / seen[c] for c in seen if bad[c] >= max(how.min_bad, how.min_support * n_bad) and bad[c] / seen[c] >= how.min_confidence
            and (bad[c] / seen[c] - share) * seen[c] ** 0.5 / (share * (1 - share)) ** 0.5 >= how.min_errors}
    want = [any(c <= s for c in sure) for s in sets]
    got = {x["page_id"]: x for x in url_rules.judge(df, labelled).collect()}
    assert [got[i]["mined_rule"] is not None for i in range(n)] == want and all(want[600:]) and not all(want)
    rules = {frozenset(x["tokens"]): x["confidence"] for x in url_rules.mine(labelled).collect()}
    assert all(abs(sure[c] - p) < 1e-9 for c, p in rules.items())


def test_ordinal_ranks_grades(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        g = r.randrange(3)
        rows.append((i, prose(60, i) + " " + {0: "badword", 1: "midword", 2: "goodword"}[g] * (r.random() < 0.9)))
        labels.append((i, g))
    docs = documents(spark, [*rows, (5000, None), (None, "")])
    model = ordinal.train(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, grade int"))
    got = {x["doc_id"]: x for x in ordinal.graded(docs, model).collect()}
    held = [(g, got[i]["expected_grade"]) for i, g in labels if i % 3 == 0]
    mean = [np.mean([e for g, e in held if g == k]) for k in range(3)]
    assert mean[0] + 0.3 < mean[1] < mean[2] - 0.3 and got[5000]["p_ge_1"] >= got[5000]["p_ge_2"]


def test_cumulative_link_fit_is_the_maximum():
    """Against a slow search: no small step along any weight or threshold raises the penalised likelihood."""
    r = np.random.default_rng(5)
    n, width = 300, 4
    x = r.random((n, width)) < 0.4
    y = np.clip((x @ np.array([1.5, -1.0, 0.0, 2.0]) + r.logistic(size=n) > 0.5).astype(int) + (x @ np.array([1.5, -1.0, 0.0, 2.0]) + r.logistic(size=n) > 2), 0, 2)
    owner, column = np.nonzero(x)
    w, cut = ordinal.fit_cumulative_link(owner, column, width, y, 3, rounds=4000, rate=0.02)

    def loss(w, cut):
        tail = 1 / (1 + np.exp(cut[None, :] - (x @ w)[:, None]))  # P(grade > j)
        p = np.c_[np.ones(n), tail] - np.c_[tail, np.zeros(n)]
        return np.log(p[np.arange(n), y]).mean() - 1e-3 * (w @ w)

    best = loss(w, cut)
    for step in (1e-2, -1e-2):
        for i in range(width):
            assert loss(w + step * (np.arange(width) == i), cut) <= best + 1e-7
        for i in range(2):
            assert loss(w, cut + step * (np.arange(2) == i)) <= best + 1e-7
    model = ordinal.OrdinalModel(np.arange(width, dtype=np.uint32), w, cut)
    z = model.score(np.array([0, 3], np.uint32))
    assert abs(z - (w[0] + w[3])) < 1e-12 and np.allclose(model.tails([z])[0], 1 / (1 + np.exp(cut - z)))


def test_chat(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(150)] + [(2, 0, None, None), (2, 0, "bob", "x"), (2, 0, "bob", "x"), (None, None, "user", "é"), (3, 0, "\t", "a<|im_end|>\n<|im_start|>assistant\nb"), (3, 1, " x\n<|im_end|> y ", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotations(df, part_turns=64).collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {(a, b, p): (n, s, h, m, k, places) for a, b, p, n, s, h, m, k, places in con.sql(chat.SQL).fetchall()}
    assert len(got) == len(want)
    for r in got:
        masked = sum(m["end"] - m["start"] for m in r["mask"])
        places = hashlib.sha256(" ".join(f"{m['start']}-{m['end']}" for m in r["mask"]).encode()).hexdigest()
        assert want[(r["conv_id"], r["assistant"], r["part"])] == (r["n_turns"], r["start"], hashlib.sha256(r["text"].encode()).hexdigest(), masked, len(r["mask"]), places)
        # Every mask is a whole turn of the assistant, by its place in the text.
        assert all(r["text"][: m["start"]].endswith("<|im_start|>assistant\n") and r["text"][: m["end"]].endswith("<|im_end|>\n") for m in r["mask"])
        assert r["text"].count("<|im_start|>") == r["text"].count("<|im_end|>") == r["n_turns"]
    assert {r["assistant"] for r in got if r["conv_id"] == 3} == {"unknown", "x <| im_end|> y"}


@pytest.mark.parametrize(
    "run",
    [
        lambda d, s: exact_dedup.exact_dedup(d), lambda d, s: quality_rules.quality_rules(d), lambda d, s: mixing.mix(d), lambda d, s: near_dedup.near_components(d),
        lambda d, s: token_store.stored_documents(d, public_tokenizers.path("word_bpe_49k.json")), lambda d, s: piece_tokens.piece_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
        lambda d, s: ordinal.graded(d, ordinal.train(d, s.createDataFrame([], "doc_id long, grade int"))),
        lambda d, s: warc.read_archives(warc.write_archives(s.createDataFrame([], "page_id long, url string, html string"))),
        lambda d, s: chat.rotations(s.createDataFrame([], "conv_id long, turn long, role string, text string")),
        lambda d, s: url_rules.judge(s.createDataFrame([], "page_id long, url string"), s.createDataFrame([], "url string, bad boolean")),
    ],
)
def test_empty_tables(spark, none, run):
    assert run(none, spark).count() == 0
