"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base findings are patterns: e-mail, IP address, payment card, phone number. Each distinct value is a
protected entity, and so are what values share, their part (an address's host, a network, an issuer, a
dialling code) and their kind: most values stand in one text only, which is no evidence. A term that
keeps standing next to an entity reveals it even when the entity is masked. How much, the corpus tells: with document frequencies n_t, n_e and n_te (term in the context
of the entity), the pointwise mutual information log(N n_te / (n_t n_e)) is the share of the entity's
information log(N / n_e) that the term discloses. Terms over the upper threshold are removed from the
documents that hold the entity (of a part or kind: that have the term in its context), those over the
lower one are generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.llm.common import shielded
from papersieve.session import materialize, with_computed

KINDS = ("email", "ip", "card", "phone")
#: Where a pattern begins with a run of one class, a match may only begin where the run does (or the
#: previous match ended): any later beginning fails as the first one did, and long runs stay linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no valid match.
HINTS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_VALUE = rf"^{_PART}(?:\.{_PART}){{3}}$"

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
WORD = r"\p{L}{3,}"

#: Words on either side of an entity that are its context, the characters they are looked for in,
#: distinct texts that must agree, and the shares of the entity's information that generalise and remove.
CONTEXT_WORDS, CONTEXT_CHARS, SUPPORT, GENERALISE, REMOVE = 8, 160, 3, 0.8, 0.95
#: Candidate terms that are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000


def matches(text: Column, kind: str | Column, pattern: str | Column, hint: str | None = None) -> Column:
    """All leftmost non-overlapping matches with their places in code points, end exclusive."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.split(text, regex, -1)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("spans"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["found"])
        span = F.struct(kind.alias("kind"), begin.alias("start"), end.alias("end"), pair["found"].alias("value"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["spans"], F.array().cast(SPAN)), F.array(span)).alias("spans"))

    def walk(both):
        pairs = F.zip_with(
            F.slice(both["gaps"], F.lit(1), F.size(both["found"])), both["found"],
            lambda g, m: F.struct(g.alias("gap"), m.alias("found")),
        )
        return F.aggregate(pairs, start, step, lambda acc: F.coalesce(acc["spans"], F.array().cast(SPAN)))

    # an array of one, so that either search runs once
    spans = F.get(F.transform(F.array(F.struct(gaps.alias("gaps"), found.alias("found"))), walk), 0)
    return F.when(text.rlike(hint) if hint else F.lit(True), spans).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes the Luhn check."""
    reverse = F.rpad(F.reverse(digits), 20, "0")

    def value(i):
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """The valid base findings, by kind in the order of KINDS, then by place."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    valid = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["value"].rlike(IP_VALUE),
        "card": lambda s: F.when(F.length(digits(s)).between(13, 19), luhn(digits(s))).otherwise(False),
        "phone": lambda s: F.length(digits(s)).between(9, 15),
    }
    return F.concat(*(F.filter(matches(text, k, PATTERNS[k], HINTS[k]), valid[k]) for k in KINDS))


def _key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumn("_id", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))).withColumn(
        "_hash", F.xxhash64(text)
    )


def protected(kind: Column, value: Column) -> Column:
    """The entities a finding stands for, as structs (level, entity): its value, its part, its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = (
        F.when(kind == "email", F.substring_index(F.lower(value), "@", -1)).when(kind == "ip", F.substring_index(value, ".", 3))
        .when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 3))
    )
    names = {"value": F.lower(value), "part": part, "kind": F.lit("")}
    return F.array(*(F.struct(F.lit(level).alias("level"), F.concat_ws(":", F.lit(level), kind, name).alias("entity")) for level, name in names.items()))


def entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _hash, level, entity, terms) with the words around every occurrence, three rows for each finding."""
    found = (
        with_computed(_key(docs.select(doc_id, F.col(text).alias("text")), doc_id, "text"), "spans", base_spans(F.col("text")))
        .select("_id", "_hash", "text", F.explode("spans").alias("s"))
    )
    before = F.substring("text", F.greatest(F.lit(1), F.col("s.start") + 1 - CONTEXT_CHARS), F.least(F.col("s.start"), F.lit(CONTEXT_CHARS)))
    after = F.substring("text", F.col("s.end") + 1, F.lit(CONTEXT_CHARS))
    near = lambda part: F.regexp_extract_all(F.lower(part), F.lit(WORD), F.lit(0))
    term = F.array_distinct(F.concat(
        F.slice(F.reverse(near(before)), 1, CONTEXT_WORDS), F.slice(near(after), 1, CONTEXT_WORDS)
    ))
    return with_computed(found, "terms", term).select(
        "_id", "_hash", F.inline(protected(F.col("s.kind"), F.col("s.value"))), "terms"
    ).select("_id", "_hash", "level", "entity", "terms")


def disclosing_terms(
    docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE
) -> DataFrame:
    """(entity, term, disclosure) of the terms that disclose at least ``generalise`` of an entity.

    A term needs the evidence of ``support`` distinct texts. Its document frequency is counted over
    all documents, that of entities and pairs over all their occurrences. Both are counted before they
    meet, so an entity in a third of all documents is one row of a join.
    """
    n = float(max(1, docs.count()))
    information = F.log(F.lit(n) / F.col("n_e"))
    mutual = F.log(F.lit(n) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    share = F.when(information > 0, mutual / information).otherwise(F.lit(0.0))
    per_entity = found.groupBy("entity").agg(F.count_distinct("_id", "_hash").alias("n_e"))
    near = found.select("_id", "_hash", "level", "entity", F.explode("terms").alias("term"))
    pairs = (
        near.groupBy("entity", "term")
        .agg(F.count_distinct("_id", "_hash").alias("n_te"), F.count_distinct("_hash").alias("texts"))
        .filter(F.col("texts") >= support).drop("texts").join(per_entity, "entity")
    )
    # A term stands in at least as many documents as have it in some context: pairs that fall short of
    # the threshold even so are settled before the words of all documents are counted.
    least = near.filter("level = 'value'").select("_id", "_hash", "term").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    pairs = materialize(pairs.join(least, "term").filter(share >= generalise).drop("n_t"))
    candidates = pairs.select("term").distinct()
    if candidates.count() <= BROADCAST_TERMS:
        candidates = F.broadcast(candidates)
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)))).alias("term"))
    frequency = words.join(candidates, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    return (
        pairs.join(frequency, "term").withColumn("disclosure", share).filter(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")
    )


def terms_of_documents(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """(_id, _hash, _terms): the disclosing terms of every document with their largest disclosure.

    A value's terms hold for the whole document, those of a part or kind where they stand in its context.
    """
    flagged = materialize(flagged)
    if flagged.count() <= BROADCAST_TERMS:
        flagged = F.broadcast(flagged)
    whole = found.filter("level = 'value'").select("_id", "_hash", "entity").distinct().join(flagged, "entity")
    near = found.filter("level <> 'value'").select("_id", "_hash", "entity", F.explode("terms").alias("term")).distinct().join(flagged, ["entity", "term"])
    columns = ["_id", "_hash", "term", "disclosure"]
    return (
        whole.select(columns).union(near.select(columns))
        .groupBy("_id", "_hash", "term").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("_id", "_hash").agg(F.collect_list(F.struct("term", "disclosure")).alias("_terms"))
    )


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """``docs`` with a column ``spans``: base findings, then ``general`` and ``term`` spans of disclosing terms.

    Spans are (kind, start, end, value) in code points, end exclusive, by kind, then start. A term
    span never overlaps a base span. A null or empty text has none. Rows that share an id are told
    apart by their text; equal rows get equal spans; an empty table stays empty. Of further columns
    only _id, _hash, _terms and spans may not be there; they are replaced.
    """
    docs = docs.drop("_id", "_hash", "_terms", "spans")
    found = materialize(entities(docs, doc_id, text))
    per_doc = terms_of_documents(found, disclosing_terms(docs, found, text, **options))
    keyed = _key(docs, doc_id, text).join(per_doc, ["_id", "_hash"], "left")
    column = F.col(text)
    with_base = with_computed(keyed, "spans", F.coalesce(base_spans(column), F.array().cast(SPAN)))

    def term_spans(kind: str, some: Column) -> Column:
        names = F.sort_array(F.transform(F.filter("_terms", lambda t: some(t["disclosure"])), lambda t: t["term"]))
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
        spans = F.filter(
            matches(column, kind, pattern),
            lambda s: ~F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        return F.when(F.size(names) > 0, spans).otherwise(F.array().cast(SPAN))

    extra = F.concat(
        term_spans("general", lambda d: d < remove), term_spans("term", lambda d: d >= remove)
    )
    all_spans = F.when(F.col("_terms").isNull(), F.col("spans")).otherwise(F.concat("spans", extra))
    return with_computed(with_base, "spans", all_spans).drop("_id", "_hash", "_terms")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the number of base findings of each kind, base_sha256 and all spans of every row."""
    found = find_personal_data(docs.select("doc_id", "text"), **options)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with personal data masked in ``text``: [EMAIL] and the like, [WORD] for generalised terms, nothing for removed ones.

    A null text stays null, equal rows are masked alike, an empty table stays empty. Further columns
    keep their values whatever their names.
    """
    return shielded(docs, (doc_id, text), lambda rows: _masked(rows, doc_id, text, **options))


def _masked(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    found = find_personal_data(docs, doc_id, text, **options)
    column = F.col(text)
    mask = lambda s: F.when(s["kind"] == "term", "").when(s["kind"] == "general", "[WORD]").otherwise(
        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    )
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mask(s).alias("mask"))))

    def step(acc, s):
        more = F.concat(acc["out"], F.substring(column, acc["at"] + 1, s["start"] - acc["at"]), s["mask"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(column, acc["at"] + 1, F.length(column)))
    )
    return found.withColumn(text, F.when(F.size("spans") > 0, masked).otherwise(column)).select(docs.columns)
