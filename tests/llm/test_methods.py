"""The operators that SQL cannot express, and the pipeline's stages, against plain versions of their methods."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cinelith.llm import decontamination, line_dedup, lm_scoring, minhash, packing, pii, suffix_dedup, topk, toxicity, url_filter

EMPTY = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>",
}


def crc(i, modulus):
    return zlib.crc32(b"" if i is None else str(i).encode()) % modulus


# ---- language model ----

LM_TEXTS = [None, "", "a b", "One two one", "naïve café", "one\ttwo  two\nthree", "x" * 300, "abracadabra abracadabra", "one"]


def successors(text, order):
    """(context of `order` symbols, symbol) at every place; 256 ends a text and stands before it."""
    every = [256] * order + [*text, 256]
    return [(tuple(every[i : i + order]), every[i + order]) for i in range(len(every) - order)]


def ppm_by_hand(train, texts, order=4):
    seen = defaultdict(Counter)
    for t in train:
        for context, symbol in successors(t, order):
            for k in range(order + 1):
                seen[context[order - k :]][symbol] += 1
    out = []
    for t in texts:
        total = 0.0
        for context, symbol in successors(t, order):
            excluded = set()
            for k in range(order, -1, -1):
                left = {s: c for s, c in seen.get(context[order - k :], {}).items() if s not in excluded}
                if not left:
                    continue
                mass = sum(left.values()) + len(left)
                if symbol in left:
                    total += math.log10(left[symbol] / mass)
                    break
                total += math.log10(len(left) / mass)
                excluded |= left.keys()
            else:
                total -= math.log10(max(257 - len(seen.get((), {})), 1))
        out.append(total)
    return out


def lm_rows(rows):
    """{doc_id: (n_tokens, n_known, N, base, score)} by hand."""
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    train = [(i, t) for i, t in rows if crc(i, 10)]
    counts = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    scores = ppm_by_hand([(t or "").encode() for _, t in train], [(t or "").encode() for _, t in rows])
    base = [sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)) for _, t in rows]
    return [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(b, 7), round(s, 7)) for (i, t), b, s in zip(rows, base, scores, strict=True)]


@pytest.mark.parametrize(("most", "chunk", "part"), [(10**6, 0, 0), (0, 1 << 24, 1 << 18), (0, 200, 40)])
def test_lm_scoring(spark, most, chunk, part):
    rng = np.random.default_rng(4)
    rows = [*enumerate(LM_TEXTS), (None, "no id"), (3, LM_TEXTS[3]), *((i, " ".join(rng.choice(["one", "two", "café", "Z", "zebra!"], 8))) for i in range(20, 60))]
    docs = spark.createDataFrame([(i, t, 1, 2, "c", "d") for i, t in rows], "doc_id long, text string, chunk long, row int, rest string, value string").repartition(3)
    found = lm_scoring.score(docs, max_grams=most, chunk=chunk, part_grams=part).collect()
    got = Counter((r.row.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in found)
    assert got == Counter(lm_rows(rows))
    assert all(r.row.chunk == 1 and r.row.rest == "c" for r in found) and Counter(r.row.text for r in found) == Counter(t for _, t in rows)


def test_lm_scoring_without_training_rows(spark):
    held = [i for i in range(200) if crc(i, 10) == 0][:3]
    docs = spark.createDataFrame([(i, "some text") for i in held], "doc_id long, text string")
    found = lm_scoring.digest(docs).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 9)) for r in found] == [(3, 0, 0, True, 0.0)] * 3
    assert all(math.isclose(r.score, -10 * math.log10(257)) for r in found)


# ---- URL filter ----


def markov_by_hand(train, text, order=4):
    """Witten-Bell interpolation of orders 0 to `order`: log probability of text and its end."""
    seen = defaultdict(Counter)
    for t in train:
        for context, symbol in successors(t, order):
            for k in range(order + 1):
                seen[context[order - k :]][symbol] += 1
    total = 0.0
    for context, symbol in successors(text, order):
        p = 1 / 257
        for k in range(order + 1):
            here = seen.get(context[order - k :])
            if here:
                p = (here[symbol] + len(here) * p) / (sum(here.values()) + len(here))
        total += math.log(p)
    return total


def rule_by_hand(url):
    """(host, path, rule, verdict)."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_url_filter(spark, most):
    rng = np.random.default_rng(7)
    words = ["news", "shop", "casino", "WIN", "bonus", "blog", "été"]
    urls = [f"http://{rng.choice(words)}.{rng.choice(['com', 'net', 'org', 'example.com', 'www.example.com'])}/{rng.choice(['en', 'fr', 'es', ''])}/{rng.choice(words)}?q={i % 7}#{i % 3}" for i in range(160)]
    urls += [None, "", "no scheme", "://", "http://example.com", "http://EXAMPLE.com/en/", "ftp://x.Net/fr/a", "http://net/es/", "a://b://com/"] + urls[:3]
    pages = spark.createDataFrame([(i, u, "c", 0.5, "r") for i, u in enumerate(urls)], "page_id long, url string, text string, score double, rule string")
    found = {r.page_id: r for r in url_filter.judge(pages, max_grams=most).collect()}
    assert len(found) == len(urls)
    split = {r.page_id: r.s for r in pages.select("page_id", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(url_filter.CALIBRATION)).alias("s")).collect()}
    ruled = {i: rule_by_hand(u) for i, u in enumerate(urls)}
    train = {v: [(urls[i] or "").encode() for i in found if ruled[i][3] == v and split[i]] for v in ("allow", "block")}
    free = defaultdict(list)
    for i, r in found.items():
        assert (r.host, r.path, r.rule) == ruled[i][:3]
        text = (urls[i] or "").encode()
        want = (markov_by_hand(train["allow"], text) - markov_by_hand(train["block"], text)) / (len(text) + 1) if text else 0.0
        assert math.isclose(r.score, want, abs_tol=1e-9)
        if ruled[i][3]:
            assert r.verdict == ruled[i][3]
        else:
            free[r.verdict].append(r.score)
    # one threshold parts the URLs that no rule fits
    assert min(free["allow"], default=9) >= max(free["block"], default=-9)


# ---- personal data ----

_BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9](?:[\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
)


def digits(m):
    return re.sub("[^0-9]", "", m)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_by_hand(text):
    spans = [(m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(_BASE) for m in pattern.finditer(text) if ok(m[0])]
    return [(_BASE[k][0], a, b) for a, k, b in sorted(spans)]


def test_pii_base_spans(spark):
    rng = np.random.default_rng(10)
    bits = ["a@b.co", "x.y+z@q-r.s.t", "@", ".", "1.2.3.4", "256.1.1.1", "10.0.0.001", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0143", "+12", "+1234567890123456", "-", " ", "é", "😀", "word", "00", "1" * 19, "\n", "a@b", "..@..co.x"]
    texts = [None, "", "7" * 400, "a" * 3000 + "@b.co", "1.1.1.1 " * 300] + ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "e", [1]) for i, t in enumerate(texts)], "doc_id long, text string, base string, told array<int>")
    for r in pii.digest(docs).collect():
        spans = base_by_hand(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]


# ---- toxicity ----


def ftrl_by_hand(rows, passes, l1, alpha=2.0, beta=1.0, l2=0.1):
    """z, n and weights by feature, from (features, label) in order."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(passes):
        for features, label in rows:
            at = [*sorted(features, key=str), "bias"]
            w = {f: weight(f) for f in at}
            p = 1 / (1 + math.exp(-max(min(sum(w.values()), 35), -35)))
            g = (p - label) * (toxicity.POSITIVE if label else 1.0)
            for f in at:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return weight


def features_by_hand(text):
    w = re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).split(" ")
    w = [x for x in w if x]
    return {*w, *zip(w, w[1:], strict=False), *(("skip", a, b) for a, b in zip(w, w[2:], strict=False))}


def test_toxicity(spark):
    rng = np.random.default_rng(11)
    mild, rude = ["dear", "friend", "the", "of", "Paper", "naïve"], ["idiot", "fool", "you", "the", "awful"]
    texts = {i: " ".join(rng.choice(rude if i % 3 == 0 else mild, 12)) + ("!" if i % 2 else "") for i in range(400)}
    texts |= {500: None, 501: "", 502: "idiot " * 5000}
    docs = spark.createDataFrame([(i, t, 1, 0.5, "c") for i, t in texts.items()] + [(None, "no id", 1, 0.5, "c"), (7, texts[7], 1, 0.5, "c")], "doc_id long, text string, toxic int, score double, at string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 400)] + [(5, 1), (None, 1), (900, 0), (6, None)], "doc_id long, toxic int")
    label = {i: int(i % 3 == 0 or i == 5) for i in range(400)}
    order = [r.doc_id for r in docs.where("doc_id < 400").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).collect() if crc(r.doc_id, 5)]
    l1 = 12.0 * min(1.0, len(order) / toxicity.MAX_TRAIN) ** 0.25
    weight = ftrl_by_hand([(features_by_hand(texts[i]), label[i]) for i in order], toxicity.PASSES, l1)
    found = toxicity.digest(docs, labels).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        want = 1 / (1 + math.exp(-sum(map(weight, [*features_by_hand(texts.get(r.doc_id, "no id")), "bias"]))))
        assert math.isclose(r.score, want, abs_tol=1e-5) and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id, 5) == 0)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == label[r.doc_id] for r in held) > 0.9 * len(held)
    # fewer rows than labels: those of the least hashes, for any partitioning
    one, two = (sorted((str(r.doc_id), r.score) for r in toxicity.digest(d, labels, 60).collect()) for d in (docs, docs.repartition(7)))
    assert one == two
    assert toxicity.reject_toxic(docs, labels).columns == docs.columns
    assert toxicity.digest(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0] == 0.0


# ---- decontamination ----


def edits_by_hand(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def contaminated_by_hand(text, items):
    text = decontamination.normalise(text)
    plain = [(i, decontamination.normalise(t)) for i, t in items]
    return sorted(i for i, t in plain if t and edits_by_hand(t, text) <= len(t) // decontamination.CHARS_PER_EDIT)


@pytest.mark.parametrize("block", [10**6, 90])
def test_decontamination(spark, block):
    rng = np.random.default_rng(12)
    items = [(1, "What is the airspeed velocity of an unladen swallow?"), (2, None), (3, " !? "), (4, "Étude in E♭ major, the naïve one"), (5, "aba aba aba aba aba aba"), (6, "What is the airspeed velocity of an unladen swallow?"), (6, "q")]
    texts = [None, "", "aba " * 40, "nothing of it", "WHAT is the\nairspeed velocity"]
    for _ in range(120):
        i, t = items[rng.choice([0, 3, 4])]
        copy = list("before " + t + " after")
        for at in rng.integers(0, len(copy), rng.integers(0, 6)):
            copy[at] = ["", "x", copy[at] + "y", "é"][rng.integers(4)]
        texts.append("".join(copy))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, hits int, row string")
    found = decontamination.judge(docs, bench, block_chars=block).select("row.doc_id", "hits.item_id").collect()
    assert {r.doc_id: sorted(r.item_id) for r in found} == {i: contaminated_by_hand(t, items) for i, t in enumerate(texts)}
    assert decontamination.remove_contaminated(docs, bench).columns == docs.columns


# ---- empty tables, long texts ----


@pytest.mark.parametrize(
    "run",
    [
        lambda t: toxicity.digest(t("documents"), t("labels")), lambda t: line_dedup.digest(t("documents")), lambda t: pii.digest(t("documents")),
        lambda t: minhash.digest(t("documents")), lambda t: packing.digest(t("documents")), lambda t: lm_scoring.digest(t("documents")),
        lambda t: url_filter.digest(t("pages")), lambda t: topk.digest(t("embeddings")), lambda t: suffix_dedup.digest(t("documents")),
        lambda t: decontamination.digest(t("documents"), t("benchmark")),
    ],
)
def test_empty_tables(spark, run):
    assert run(lambda name: spark.createDataFrame([], EMPTY[name])).count() == 0


def test_long_texts(spark):
    rng = np.random.default_rng(13)
    long = " ".join(map(str, rng.integers(0, 10**9, 60_000))) + " mail a@b.co"
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, long + " more")], "doc_id long, text string")
    size = len(long)
    assert [r.n_email for r in pii.digest(docs).orderBy("doc_id").collect()] == [1, 0, 1]
    assert [(r.doc_id, r.component_id) for r in minhash.digest(docs).orderBy("doc_id").collect()] == [(1, 1), (2, 2), (3, 1)]
    assert [(r.n_bytes, r.n_removed) for r in suffix_dedup.digest(docs).orderBy("doc_id").collect()] == [(size, 0), (5, 0), (size + 5, size)]
    assert [r.n_lines for r in line_dedup.digest(docs).orderBy("doc_id").collect()] == [1, 1, 1]
    assert [r.n_tokens for r in lm_scoring.digest(docs).orderBy("doc_id").collect()] == [60_003, 2, 60_004]
    bench = spark.createDataFrame([(1, long[200_000:200_300])], "item_id long, text string")
    assert [r.n_items for r in decontamination.digest(docs, bench).orderBy("doc_id").collect()] == [1, 0, 1]


# ---- the pipeline ----


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(14)
    words = ["river", "stone", "house", "letter", "morning", "paper", "window", "garden", "silver", "bread"]
    item = "What colour was the bridge that Anna crossed on her way to the old mill?"
    base = [" ".join(rng.choice(words, 30)) for _ in range(60)]
    rows = [(i, t + "\nAll rights reserved.\nend " + str(i % 4), "en", "web", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, f"you idiot fool {rng.choice(words)} awful idiot you fool {i}", "en", "forum", 9) for i in range(40)]
    rows += [(200, base[3] + " and more", "en", "web", 9), (201, base[3], "de", None, None), (202, None, None, None, None), (203, "", "", "", 0), (204, base[7] + " " + item.upper(), "en", "web", 5), (None, "no id", "en", "web", 5)]
    docs = spark.createDataFrame(rows, EMPTY["documents"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(60), *range(100, 140)]], EMPTY["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], EMPTY["benchmark"]).write.parquet(f"{tmp_path}/benchmark.parquet")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near-duplicates", "decontamination", "packing"]
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scores = Counter((r.doc_id, r.predicted) for r in toxicity.digest(docs, labels).collect())

    def of(name, before):
        out = stages[name](spark, spark.createDataFrame(before, EMPTY["documents"]), str(tmp_path))
        assert name == "packing" or out.schema.simpleString() == spark.createDataFrame([], EMPTY["documents"]).schema.simpleString()
        return [tuple(r) for r in out.collect()]

    kept = of("toxicity", rows)
    assert Counter(r[0] for r in kept) == Counter({i: n for (i, p), n in scores.items() if not p})
    assert {r[0] for r in kept} >= {*range(60)} and not {r[0] for r in kept} & {*range(100, 140)}

    lines = of("line dedup", kept)
    key = lambda s: s.strip(" \t\n\x0b\f\r").lower()
    held = defaultdict(set)
    for r in kept:
        for line in (r[1] or "").split("\n"):
            held[key(line)].add(r[0])
    want = Counter()
    for i, t, lang, source, _ in kept:
        text = "\n".join(x for x in (t or "").split("\n") if not key(x) or len(held[key(x)]) < 10)
        want[(i, text, lang, source, len(text))] += 1
    assert Counter(lines) == want and not any("rights" in r[1] for r in lines)

    single = of("near-duplicates", lines)
    sets = {r[0]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for r in lines for w in [r[1].lower().split()]}
    gone = {b for b in sets for a in sets if a is not None and b is not None and a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert Counter(single) == Counter(r for r in lines if r[0] not in gone) and {200, 201} <= gone

    clean = of("decontamination", single)
    assert Counter(clean) == Counter(r for r in single if not contaminated_by_hand(r[1], [(1, item)])) and len(single) == len(clean) + 1

    plain = Tokenizer.from_file(packing.default_tokenizer())
    total = {r[0]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in clean}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter({i: len(t) for i, t in total.items()}) == Counter({i: sum(p.length for p in pieces if p.doc_id == i) for i in total})
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(total[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(total[p.doc_id])


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.createDataFrame([], EMPTY[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
