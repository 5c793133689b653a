import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cinelith.llm import decontamination, line_dedup, minhash, packing, pii, suffix_dedup, topk

SCHEMA = "doc_id long, text string, rk1 string, row string, lines string, score double"
TEXTS = [None, "", "a b", "One\n two \nTHREE\n\n", "x" * 3000, "same line here\nother", "same line here\nother", "mail a@b.co now +1 202 555 0143 ok", "4111 1111 1111 1111 at 10.0.0.1"]


def table(spark, extra=()):
    """Nulls, empties, repeats, ties and columns whose names clash with inner ones."""
    base = "the quick brown fox jumps over the lazy dog again and again until the evening comes down on all of them"
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3]), (50, base), (51, base + " x"), (52, base.upper())] + list(extra)
    return spark.createDataFrame([(i, t, "c", "c", "c", 0.5) for i, t in rows], SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_line_dedup(spark):
    docs = table(spark)
    every = rows_of(docs)
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\f\r"))
    held = {}
    for i, t in every:
        for line in t.split("\n"):
            held.setdefault(key(line), set()).add(i)
    want = Counter()
    for i, t in every:
        lines = t.split("\n")
        kept = [x for x in lines if not key(x) or len(held[key(x)]) < 2]
        want[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in line_dedup.digest(docs, 2).collect()) == want
    first = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, 2, keep_first=True).collect()}
    assert (5, "same line here\nother") in first and (6, "") in first


def test_pii(spark):
    found = {r.doc_id: r for r in pii.digest(table(spark)).collect()}
    assert (found[7].n_email, found[7].n_phone, found[8].n_card, found[8].n_ip) == (1, 1, 1, 1)
    assert found[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    near = [(100 + i, f"call projectzeus a@b.co today {i}") for i in range(4)] + [(200 + i, "call me today maybe") for i in range(60)]
    terms = {r.doc_id: r.spans for r in pii.digest(table(spark, near)).collect()}
    assert "term:5:16" in terms[100] and "term:0:4" not in terms[100]
    clean = {r.doc_id: r.text for r in pii.sanitise(table(spark, near)).collect()}
    assert "[EMAIL]" in clean[100] and "projectzeus" not in clean[100]


def test_pii_far_terms(spark):
    rows = [(i, "call me today maybe") for i in range(60)] + [(100 + i, "Quixote " + "call today maybe " * 20 + "q@b.co") for i in range(4)] + [(200, "call quixote today")]
    found = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:0:7" in found[100] and found[200] == "term:5:12" and found[0] == ""


def pii_terms(rows):
    """(doc_id, start, end) of every disclosing term by brute force, where all base spans are e-mail addresses of a fixed form."""
    blank = [(i, re.sub(r"[a-z0-9]+@[a-z0-9.]+", lambda m: " " * len(m[0]), t)) for i, t in rows]
    held = [set(re.findall(r"[a-z0-9]+@[a-z0-9.]+", t)) for _, t in rows]
    words = [set(re.findall(r"[^\W\d_]{3,}", t.lower())) for _, t in blank]
    n, n_e, n_t = len(rows), Counter(e for h in held for e in h), Counter(t for w in words for t in w)
    n_et = Counter((e, t) for h, w in zip(held, words, strict=True) for e in h for t in w)
    told = {t for (e, t), c in n_et.items() if n_e[e] < n and math.log2((c + n_e[e] / n) / (n_t[t] + 1) * n / n_e[e]) / math.log2(n / n_e[e]) >= 0.8}
    return {(i, m.start(), m.end()) for i, t in blank for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in told}


def test_pii_rare_and_far_terms(spark):
    rng = np.random.default_rng(6)
    common = ["call", "today", "maybe", "letter", "house", "Über", "river", "stone"]
    rows = [(i, " ".join(rng.choice(common, 12))) for i in range(300)]
    rows[3] = (3, "Zebulon " + rows[3][1] + " z@b.co")  # one address, seen once
    rows[4] = (4, "Quixote " + "call today maybe " * 20 + "q@b.co zero")  # further off than 64 places
    rows[5] = (5, "call quixote today")  # the word alone
    rows[6] = (6, "s@b.co call s@b.co and sometimes t@b.co")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    one, two = (Counter((r.doc_id, str(sorted(r.terms or []))) for r in pii.detect(docs, max_terms=m).collect()) for m in (10**6, 0))
    assert one == two
    assert "term:0:7" in found[3] and "term:0:7" in found[4] and found[5] == "term:5:12"
    got = {(i, *map(int, s.split(":")[1:])) for i, spans in found.items() for s in spans.split(",") if s.startswith("term")}
    assert got == pii_terms(rows)


def test_minhash(spark):
    docs = table(spark)
    sets = {}
    for i, t in rows_of(docs):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    component = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a is not None and b is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
    for r in minhash.digest(docs).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), component[r.doc_id])
    assert {50}.isdisjoint(r.doc_id for r in minhash.drop_near_duplicates(docs).where("doc_id in (51, 52)").collect())


def components_by_hand(rows):
    """(doc_id, n_shingles, component_id) of every row; rows that repeat an id are one document."""
    sets = []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    component = {i: i for i, _ in rows}
    for _ in rows:
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                    component[a] = component[b] = min(component[a], component[b])
    return Counter((i, len(x), component[i]) for i, x in sets)


def test_minhash_repeated_ids(spark):
    rng = np.random.default_rng(9)
    one, two, three, four = (" ".join(map(str, rng.integers(0, 10**6, 40))) for _ in range(4))
    rows = [(3, one), (5, one), (5, two), (7, two + " end"), (8, three), (8, four), (8, None), (9, four), (None, one), (11, ""), (12, three), (12, three), (13, "a b"), (13, "")]
    docs = spark.createDataFrame([(i, t, 1, "c", [1]) for i, t in rows], "doc_id long, text string, rk long, rep string, u array<int>")
    for sent in (minhash.MOST_SENT, 0):
        found = minhash.near_duplicates(docs, most_sent=sent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == components_by_hand(rows)
    kept = {(r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs).collect()}
    assert {i for i, _ in kept} == {3, 8, None, 11, 13} and (8, four) in kept


def test_minhash_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 10**6, 120)
    texts = []
    for i in range(40):
        w = base.copy()
        w[rng.choice(120, 1)] = rng.integers(0, 10**6, 1)
        texts.append((i, " ".join(map(str, w))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    reps = minhash.signatures(docs).selectExpr("doc_id AS rep", "u")
    comp = reps.selectExpr("rep", "IF(rep % 3 = 0, 0, rep) AS comp")
    members, full = minhash.table_members(reps), docs.withColumnRenamed("doc_id", "id")
    one, two = (Counter(tuple(r) for r in minhash.open_pairs(members, comp, reps, full, block=b, strand=s).collect()) for b, s in ((1024, 8192), (4, 5)))
    assert one == two and len(one) > 50 and max(one.values()) == 1
    assert not any(a % 3 == 0 and b % 3 == 0 for a, b in one)


def test_packing(spark):
    from tokenizers import Tokenizer

    special = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "x " * 9 + "<|endoftext|>"]
    docs = table(spark, [(60, "A sentence. " * 900), *((61 + i, t) for i, t in enumerate(special)), (70, "word " * 30_000), (71, "e\u0301 \U0001f600 \t\r\n naïve")])
    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter(tuple([*plain.encode(t, add_special_tokens=False).ids, 0]) for _, t in rows_of(docs))
    pieces = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    got, held = Counter(), []
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids)
        held = held + p.ids if p.start else p.ids
        if len(held) == p.doc_tokens:
            got[tuple(held)] += 1
    assert got == want
    size = Counter()
    for p in pieces:
        assert p.offset == size[p.sequence_id]
        size[p.sequence_id] += p.length
    assert max(size.values()) <= 1024


@pytest.mark.parametrize("window", [16, 64, 256])
def test_cuts_are_least(window):
    """Against the plain recursion over all pairs of candidate places."""
    rng = np.random.default_rng(3)
    prices, powers = (0, 6, 20), [s for s in (128, 256, 512) if s < window]
    for _ in range(40):
        n = int(rng.integers(1, 6 * window))
        docs = np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, 8)), n))
        ends = np.unique(rng.integers(1, n + 1, rng.integers(0, 20)))
        at, price = packing.candidates(n, docs, ends, window, prices)
        assert {0, n, *docs.tolist(), *ends.tolist()} <= set(at.tolist()) and np.diff(at).max(initial=0) <= window

        def cost(size):
            return packing.SHORT if size in powers else window - size

        best = [0]
        for j in range(1, len(at)):
            best.append(min(best[i] + min(cost(at[j] - at[i]), window - (at[j] - at[i])) for i in range(j) if at[j] - at[i] <= window) + price[j])
        cuts = packing.choose_cuts(n, docs, ends, window, prices)
        priced = dict(zip(at.tolist(), price.tolist(), strict=True))
        found = sum(min(cost(b - a), window - (b - a)) + priced[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == n and max(np.diff(cuts)) <= window and found == best[-1]


def removed_by_hand(every):
    first = {}
    for i, t in sorted((x for x in every if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = Counter()
    for i, t in every:
        gone = {b for k in range(len(t) - 49) if i is not None and first[t[k : k + 50]] < i for b in range(k, k + 50)}
        want[(i, len(t), len(gone), sum(b - 1 not in gone for b in gone), hashlib.sha256(bytes(c for b, c in enumerate(t) if b not in gone)).hexdigest())] += 1
    return want


def test_suffix_dedup(spark):
    docs = table(spark, [(70, "ab" * 90), (71, "ab" * 70 + "c"), (72, "\x00" * 80), (73, "z" + "\x00" * 60)])
    assert Counter(tuple(r) for r in suffix_dedup.digest(docs).collect()) == removed_by_hand([(i, t.encode()) for i, t in rows_of(docs)])


@pytest.mark.parametrize(("part", "ranges"), [(200_000, 4096), (40, 4096), (40, 3)])
def test_suffix_dedup_hot_passage(spark, monkeypatch, part, ranges):
    """One passage in every document between different words, near copies, and parts of few entries."""
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup, "RANGES", ranges)
    rng = np.random.default_rng(8)
    names = [f"w{i}é" for i in range(30)]
    passage = "this passage stands in every single document of the table, word for word, for ever"
    rows = []
    for i in range(90):
        left, right = (" ".join(rng.choice(names, 25)) for _ in range(2))
        rows.append((i, f"{left} {passage[: 40 + i % 50]} {right} {passage} {left[:30]}"))
    for i in range(90, 120):
        rows.append((i, rows[i - 60][1].replace("w3", "W3", 1)))
    docs = spark.createDataFrame([*rows, (200, rows[5][1]), (7, rows[9][1])], "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in suffix_dedup.digest(docs).collect()) == removed_by_hand([(i, t.encode()) for i, t in rows_of(docs)])


@pytest.mark.parametrize("joined", [64, 1 << 18])
def test_suffix_dedup_many_small_runs(spark, monkeypatch, joined):
    """A part that gets many short pieces of runs joins them, so the loser tree does not widen with the input."""
    for name, value in (("_HOLD", 160), ("SORTED", 40 * suffix_dedup.WIDE), ("JOINED", joined)):
        monkeypatch.setattr(suffix_dedup, name, value, raising=False)
    merge = suffix_dedup.merge_runs

    def bounded(runs, *rest):
        assert len(runs) <= sum(r.n for r in runs) // joined + 1
        return merge(runs, *rest)

    monkeypatch.setattr(suffix_dedup, "merge_runs", bounded)
    rng = np.random.default_rng(9)
    names = [f"w{i}é" for i in range(40)]
    passages = [" ".join(rng.choice(names, 30)) for _ in range(12)]
    rows = [(i, " ".join([*rng.choice(names, 20), passages[i % 12][i % 9 :], *rng.choice(names, 20), passages[i * 5 % 12]])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert Counter(tuple(r) for r in suffix_dedup.digest(docs).collect()) == removed_by_hand([(i, t.encode()) for i, t in rows_of(docs)])


def test_packed_pieces():
    """Pieces of any sizes come back as they were, all at once."""
    rng = np.random.default_rng(2)
    for n, pieces in ((1, 1), (500, 1), (5_000, 900), (300, 300)):
        cuts = np.append(np.sort(rng.choice(np.arange(1, n), pieces - 1, replace=False)), n)
        cuts = np.append(0, cuts)
        rk = rng.integers(-(2**63), 2**63 - 1, 40)[rng.integers(0, 40, n)]
        gram, number = rng.integers(0, 2**64 - 1, n, np.uint64) & ~np.uint64(0xFFFF), rng.integers(-1, 2**31 - 1, n).astype(np.int32)
        for doc in (rk // 7, None):
            found = suffix_dedup.unpacked(suffix_dedup.packed(cuts, rk, doc, (gram, 2), (number, 0)), doc is not None, (np.uint64, 2), (np.int32, 0))
            want = [rk, *([] if doc is None else [doc]), gram, number]
            assert all((a == b).all() for a, b in zip(found, want, strict=True))


def test_loser_tree():
    rng = np.random.default_rng(1)
    for k in (1, 5, 8):
        runs, every = [], []
        for _ in range(k):
            t = np.sort(rng.integers(97, 100, (30, 6)).astype(np.uint8).view("S6").ravel())
            every += t.tolist()
            runs.append(suffix_dedup.Run(suffix_dedup.front_coded(t.view(np.uint8).reshape(30, 6)), 6, block=7))
        found = list(suffix_dedup.merge_runs(runs, chunk=11))
        strings = [s for _, _, block in found for s in block]
        assert strings == sorted(every) and strings == [every[p] for block, _, _ in found for p in block]
        shared = [s for _, block, _ in found for s in block]
        common = [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(strings, strings[1:], strict=False)]
        assert shared[1:] == common


def test_decontamination_repetitive_items():
    def least(item, text):  # edit distance of item to any stretch of text
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
            row = new
        return min(row)

    rng = np.random.default_rng(4)
    cases = [("abcdefghiabcdefghiklmnopqrst", "abxdefghiabcdefghiklmnopqrst")]
    for item in ("abcdefghiabcdefghiklmnopqrst", "a yes b no c yes d no a yes b no c yes d no", "select x from t join t on x where x in t and x in t"):
        for _ in range(150):
            copy = list("some words before " + item + " some after")
            for at in rng.choice(len(item), rng.integers(1, len(item) // 14 + 2), replace=False) + 18:
                copy[at] = ["", "z", copy[at] + "q", "#"][rng.integers(4)]
            cases.append((item, "".join(copy)))
    for item, text in cases:
        want = least(item, text)
        assert [h[3] for h in decontamination.Matcher([(1, item)], 14).find(text)] == ([want] if want <= len(item) // 14 else []), text


def best_by_hand(vectors, queries, k):
    """{query: [(rank, vec_id, score)]} of (id, list) pairs, in Python's integers."""
    usable = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(64 * np.float64(x)) for x in v]) for i, v in usable]
    out = {}
    for i, q in whole:
        if i in queries:
            every = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in whole if j != i)[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(every)]
    return out


@pytest.mark.parametrize(("segment", "wider"), [(4096, 64), (16, 2), (40, 3)])
def test_topk(spark, segment, wider):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(200)]
    vectors += [(i, [0.5, 0.25, 1.0, 0.0, 2.0]) for i in range(200, 300)]  # ties
    vectors += [(300, None), (None, [1.0]), (320, [float("nan")]), (340, [1.0, None]), (360, []), (380, [1.0]), (400, [float("inf")])]
    docs = spark.createDataFrame([(i, v, i, "c", 0) for i, v in vectors], "vec_id long, embedding array<float>, score long, v string, id int")
    wanted = docs.where("vec_id % 20 = 0")
    out = {}
    for r in topk.top_k(docs, wanted, 5, segment, 8, wider).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert out == best_by_hand(vectors, range(0, 400, 20), 5)
    assert topk.digest(docs, 20, 5).count() == sum(map(len, out.values()))
    assert topk.digest(docs.limit(0)).count() == 0


def test_topk_large_components(spark):
    vectors = [(0, [1e8, 0.0]), (20, [1.0, 2.0]), (21, [3e7, -1.0]), (22, [2.0**60, 1.0]), (40, [0.0, 2.0**55]), (41, [0.5, 2.0**-5])]
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = {(r.query_id, r.vec_id): r.score for r in topk.digest(docs).collect()}
    assert out[(0, 20)] == 409_600_000_000 and out[(20, 41)] == 64 * 32 + 128 * 2
    top = (1 << 63) - 1
    assert all(out[(q, j)] == min(max(s, -top - 1), top) for q, found in best_by_hand(vectors, (0, 20, 40), 20).items() for _, j, s in found)


def test_topk_repeated_queries(spark):
    docs = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 3.0]), (20, [1.0, 0.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.digest(docs).collect()] == [(20, 1, 5, 64 * 64)]
