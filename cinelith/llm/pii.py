"""Personal data: base patterns plus information-theoretic sanitisation, in
DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Words
are read outside these spans.  Over the whole corpus of N documents three counts
follow: in how many documents n(e) an entity value stands, in how many n(t) a
word does, and in how many n(e,t) both do, at whatever distance.  With

    p = (n(e,t) + n(e) / N) / (n(t) + 1)

for the entity's probability where the word stands (one more document at the
entity's base rate damps small counts), the pointwise mutual information divided
by the entity's information content is the share of the entity that the word
discloses:

    disclosure(e, t) = log2(p * N / n(e)) / log2(N / n(e))

Every pair that occurs is scored.  A word whose disclosure of any entity is at
least `generalise` becomes a span of kind `term` at all its places in all
documents.  sanitise() rewrites such a word as [TERM], or removes it where its
greatest disclosure reaches `remove`.

Scale: a word is one row a document and leaves each task already counted.  As
n(e,t) is n(e) at most, a word with too many documents for an entity cannot
disclose it; such pairs are dropped before they are shuffled, which changes no
result.  Pairs left are at most a document's entities times its rarer words.
Disclosing words are joined to (document, word) rows, one for each different
word of a document: by a broadcast while there are at most MAX_TERMS of them, by
a shuffled join beyond; both give equal results.

Defined cases: null or empty text has no spans (the digest is that of the empty
string); null doc_ids and repeated rows are kept as they are; columns besides
doc_id and text are ignored by the digest and passed on by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelith.llm.shared import ascii_lower, materialize, row_keys, whole_text

KINDS = ("email", "ip", "card", "phone", "term")
WORD = r"\p{L}{3,}"
MAX_TERMS = 1_000_000

# Possessive forms of the contract's patterns: equal matches, but no recursion
# in Java's regex engine and no re-scan of a run from each of its characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def located(text: str, pattern: str, kind: str = "term", wanted: str | None = None) -> str:
    """SQL for array<struct<start, end, value>> of the pattern's valid matches, in code points.

    wanted is an SQL array that a lower-cased match must be in.

    split() gives the gaps between matches, so a match starts where the lengths
    of the gaps and matches before it end.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return (
        f"aggregate(zip_with(regexp_extract_all({text}, '{quoted}', 0), split({text}, '{quoted}', -1), (m, g) -> named_struct('m', m, 'g', length(g), 'l', length(m))), "
        "named_struct('at', 0, 'found', cast(array() AS array<struct<start:int,end:int,value:string>>)), "
        "(acc, x) -> IF(x.m IS NULL, acc, named_struct('at', acc.at + x.g + x.l, 'found', "
        f"IF({f'array_contains({wanted}, lower(x.m))' if wanted else valid(kind, 'x.m')}, array_append(acc.found, named_struct('start', acc.at + x.g, 'end', acc.at + x.g + x.l, 'value', x.m)), acc.found))), "
        "acc -> acc.found)"
    )


def valid(kind: str, value: str) -> str:
    """SQL that tells whether a match counts."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "ip":
        return f"forall(split({value}, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)"
    if kind == "phone":
        return f"length({digits}) BETWEEN 10 AND 15"
    if kind == "card":
        luhn = (
            f"aggregate(transform(split(reverse({digits}), ''), d -> coalesce(try_cast(d AS int), 0)), "
            "named_struct('s', 0, 'i', 0), (a, d) -> named_struct('s', a.s + IF(a.i % 2 = 0, d, d * 2 - IF(d > 4, 9, 0)), 'i', a.i + 1), a -> a.s) % 10 = 0"
        )
        return f"IF(length({digits}) BETWEEN 14 AND 19, {luhn}, false)"
    return "true"


def base_spans(text: str) -> Column:
    """array<struct<start, kind, end, value>> sorted by start, then kind."""
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        need = f"contains({text}, '{NEEDS[kind]}')" if NEEDS[kind] else f"regexp_like({text}, '[0-9]')"
        parts.append(
            f"IF({need}, transform({located(text, PATTERNS[kind], kind)}, "
            f"s -> named_struct('start', s.start, 'kind', {k}, 'end', s.end, 'value', s.value)), "
            "cast(array() AS array<struct<start:int,kind:int,end:int,value:string>>))"
        )
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def outside(text: str, spans: str) -> Column:
    """text with blanks in place of its spans, so that places stay."""
    return F.expr(
        f"IF(size({spans}) = 0, {text}, aggregate({spans}, named_struct('at', 0, 'out', ''), (a, s) -> IF(s.end <= a.at, a, named_struct('at', s.end, "
        f"'out', concat(a.out, substring({text}, a.at + 1, greatest(s.start - a.at, 0)), repeat(' ', s.end - greatest(s.start, a.at))))), "
        f"a -> concat(a.out, substring({text}, a.at + 1))))"
    )


def detect(docs: DataFrame, generalise: float = 0.8, max_terms: int = MAX_TERMS) -> DataFrame:
    """(rk1, rk2, doc_id, base, terms): base spans and disclosing terms of each row.

    base is array<struct<start, kind, end, value>>; terms is
    array<struct<start, kind, end, disclosure>> (null where there is none).
    """
    word = WORD.replace(chr(92), chr(92) * 2)
    rows = docs.select("doc_id", whole_text().alias("text"))
    found = rows.select(F.monotonically_increasing_id().alias("at"), "doc_id", *row_keys(), "text", base_spans("text").alias("base"))
    marked = materialize(found.withColumn("text", outside("text", "base")), "entities")
    n = float(marked.count() or 1)

    each = F.explode(F.expr(f"array_distinct(transform(regexp_extract_all(text, '{word}', 0), w -> lower(w)))")).alias("term")
    words = materialize(marked.select(each).groupBy("term").agg(F.count("*").alias("n_t")), "words")
    held = marked.where("size(base) > 0")
    entity = F.explode(F.expr("array_distinct(transform(base, b -> concat(cast(b.kind AS string), ':', lower(b.value))))")).alias("entity")
    entities = held.select("at", entity)
    entities = entities.join(entities.groupBy("entity").agg(F.count("*").alias("n_e")), "entity")
    base_rate, information = F.col("n_e") / n, F.log2(n / F.col("n_e"))

    def disclosure(n_et: Column) -> Column:
        p = (n_et + base_rate) / (F.col("n_t") + 1)
        return F.when(information > 0, F.log2(p / base_rate) / information).otherwise(0.0)

    # what a pair's disclosure is at most; the margin is for rounding only
    possible = disclosure(F.least("n_e", "n_t")) >= generalise - 1e-9
    pairs = held.select("at", each).join(words, "term").join(entities, "at").where(possible)
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    scored = pairs.select("term", disclosure(F.col("n_et")).alias("disclosure")).where(F.col("disclosure") >= generalise)
    disclosing = materialize(scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing")

    sent = F.broadcast(disclosing) if disclosing.count() <= max_terms else disclosing.hint("merge")
    told = marked.select("at", each).join(sent, "term").groupBy("at").agg(F.collect_list(F.struct("term", "disclosure")).alias("told"))
    told = materialize(told, "told")
    rows = marked.join(told, "at", "left").withColumn("wanted", F.expr("transform(told, t -> t.term)"))
    terms = F.expr(
        f"IF(told IS NULL, NULL, transform({located('text', WORD, wanted='wanted')}, s -> named_struct('start', s.start, 'kind', 4, 'end', s.end, "
        "'disclosure', element_at(told, cast(array_position(wanted, lower(s.value)) AS int)).disclosure)))"
    )
    return rows.select("rk1", "rk2", "doc_id", "base", terms.alias("terms"))


def joined_spans(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def digest(docs: DataFrame, generalise: float = 0.8) -> DataFrame:
    found = detect(docs.select("doc_id", "text"), generalise)
    every = F.expr(
        "array_sort(concat(transform(base, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end)), "
        "coalesce(transform(terms, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end)), "
        "cast(array() AS array<struct<start:int,kind:int,end:int>>))))"
    )
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.withColumn("every", every).select(
        "doc_id", *counts, F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("every").alias("spans")
    )


def sanitise(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """docs with personal data rewritten in text: base spans as [EMAIL], [IP],
    [CARD], [PHONE]; terms as [TERM], or removed from `remove` on.  Of overlapping
    spans the one that starts first is rewritten and swallows the rest."""
    found = detect(docs.select("doc_id", "text"), generalise)
    marks = found.dropDuplicates(["rk1", "rk2"]).select("rk1", "rk2", "base", "terms")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", whole_text().alias("text")).select("row", "text", *row_keys())
    labels = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    edits = F.expr(
        f"array_sort(concat(transform(base, s -> named_struct('start', s.start, 'end', s.end, 'put', array({labels})[s.kind])), "
        f"coalesce(transform(terms, s -> named_struct('start', s.start, 'end', s.end, 'put', IF(s.disclosure >= {remove}, '', '[TERM]'))), "
        "cast(array() AS array<struct<start:int,end:int,put:string>>))))"
    )
    text = F.expr(
        "aggregate(edits, named_struct('at', 0, 'out', ''), (a, e) -> IF(e.start < a.at, named_struct('at', greatest(a.at, e.end), 'out', a.out), "
        "named_struct('at', e.end, 'out', concat(a.out, substring(text, a.at + 1, e.start - a.at), e.put))), "
        "a -> concat(a.out, substring(text, a.at + 1)))"
    )
    done = rows.join(marks, ["rk1", "rk2"], "left").withColumn("edits", edits).withColumn("clean", text)
    return done.select(*[F.col("clean").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
