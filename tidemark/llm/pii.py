"""PII: patterns of personal data, and information-theoretic sanitisation. DataFrame functions only.

The protected entities are what the patterns find, at three levels: the value itself, its group (an e-mail's domain, an
address's first three parts, a card's issuer, a phone number without its last seven digits) and its kind. Over the whole
corpus the operator counts documents: n of all, n(e) with entity e, n(t) with the word t anywhere, n(e, t) with both. What t
discloses of e is

    PMI(e; t) / IC(e) = log2(p(e | t) / p(e)) / -log2 p(e)     p(e) = n(e) / n     p(e | t) = (n(e, t) + s p(e)) / (n(t) + s)

of which 1 is the most, as PMI is at most IC. s documents that know nothing of t smooth what few documents say. In the
documents that hold e, terms from ``generalise`` on are replaced by their class, terms from ``remove`` on are removed. e and t
must stand together in ``support`` documents with different surroundings of e, so that copies of one passage are one witness.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NON_WORD, WORD, lower_ascii, materialize

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the patterns: they match the same places and need no stack for long runs. A place can only start
#: where a run of its first class starts or where the last match ended (\G); that spares the tries inside a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text holds that has a match at all.
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Entities, or pairs of entity and term, that are broadcast at most.
BROADCAST_ROWS = 1 << 18
SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, modulo 10, is 0."""
    marks = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    added = F.transform(marks, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0), F.lit(10))))
    return F.aggregate(added, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(number(p)) <= 3, number(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: Column | str, kind: str) -> Column:
    """Places of all matches in code points: the pieces between the matches and the matches lie end to end."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, F.lit(-1))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("len"), v.alias("value")))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))).alias("spans"))

    return F.aggregate(lengths, begin, step, lambda acc: acc["spans"])


def _passing(kind: str, spans: Column) -> Column:
    return spans if kind == "email" else F.filter(spans, lambda s: _valid(kind, s["value"]))


def base_spans(text: Column) -> Column:
    """All places of the four patterns that pass their tests, by start, then kind as listed. Null text: none."""
    none = F.array().cast(SPAN)
    found = []
    for kind in KINDS:
        may = text.contains(GUARDS[kind]) if GUARDS[kind] else F.lit(True)
        if kind != "email":
            may = may & text.rlike({"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}[kind])
        spans = F.when(may, located(text, PATTERNS[kind], kind)).otherwise(none)
        found.append(_passing(kind, spans))
    return by_place(F.concat(*found))


def by_place(spans: Column) -> Column:
    """Sorted by start, then kind as listed (term last)."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))).cast(SPAN)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def entities(text: Column, spans: Column, near: int) -> Column:
    """(entity, start, around) of a text's entities at all levels, each once, where it stands first. around: ``near`` code points on both sides."""
    digits = lambda s: _digits(s["value"])
    group = lambda s: (
        F.when(s["kind"] == "email", lower_ascii(F.substring_index(s["value"], "@", -1)))
        .when(s["kind"] == "ip", F.substring_index(s["value"], ".", 3))
        .when(s["kind"] == "card", F.substring(digits(s), 1, 6))
        .otherwise(F.substr(digits(s), F.lit(1), F.length(digits(s)) - 7))
    )
    around = lambda s: F.concat(F.substr(text, F.greatest(s["start"] - near, F.lit(0)) + 1, F.least(s["start"], F.lit(near))), F.lit("|"), F.substr(text, s["end"] + 1, F.lit(near)))
    name = lambda s: F.array(s["kind"], F.concat(s["kind"], F.lit("/"), group(s)), F.concat(s["kind"], F.lit(":"), s["value"]))
    every = F.flatten(F.transform(spans, lambda s: F.transform(name(s), lambda e: F.struct(e.alias("entity"), s["start"].alias("start"), F.xxhash64(around(s)).alias("around")))))
    every = F.array_sort(every)
    return F.filter(every, lambda x, i: (i == 0) | (x["entity"] != F.get(every, i - 1)["entity"]))


def terms_of(text: Column) -> Column:
    """The different words of a text that aren't numbers."""
    return F.filter(F.array_distinct(F.split(lower_ascii(text), f"{NON_WORD}+")), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast where its rows are few enough; else the join is left to Spark, which shuffles and splits hot keys."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def disclosing_terms(found: DataFrame, documents: DataFrame, support: int, smooth: float, generalise: float) -> DataFrame:
    """(entity, term, disclosed) with disclosed >= generalise. found: row, terms, entities of the documents that have any.

    Document frequencies are counted over all rows of documents, whole texts. Entities without ``support`` different
    surroundings can't have a term with so many, and are left out before any term is listed.
    """
    held = found.select("row", F.explode("entities").alias("e")).select("row", F.col("e.entity").alias("entity"), F.col("e.around").alias("around"))
    known = held.groupBy("entity", "around").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("around")).where(F.col("around") >= support)
    known = materialize(known.select("entity", "n_entity"), "entities")
    asked = found.select("terms", F.explode("entities").alias("e")).select("terms", F.col("e.entity").alias("name"), F.col("e.around").alias("around"))
    pairs = asked.join(_checked(known.select(F.col("entity").alias("name"))), "name").select("name", "around", F.explode("terms").alias("term"))
    # rows of a pair and surroundings are summed before their shuffle
    pairs = pairs.groupBy("name", "term", "around").agg(F.count("*").alias("n")).groupBy("name", "term").agg(F.sum("n").alias("together"), F.count("*").alias("witnesses")).where(F.col("witnesses") >= support)
    pairs = materialize(pairs.join(_checked(known), F.col("name") == F.col("entity")).drop("name"), "entity-terms")
    # numbers and the empty word are never met
    listed = F.array_distinct(F.split(lower_ascii(F.col("text").cast("string")), f"{NON_WORD}+"))
    seen = documents.select(F.explode(listed).alias("seen")).groupBy("seen").agg(F.count("*").alias("n_term"))
    n = F.lit(float(documents.count()))
    p_entity = F.col("n_entity") / n
    p_given = (F.col("together") + smooth * p_entity) / (F.col("n_term") + smooth)
    disclosed = F.log2(p_given / p_entity) / F.when(F.col("n_entity") < n, -F.log2(p_entity))
    return pairs.join(seen, F.col("term") == F.col("seen")).select("entity", "term", disclosed.alias("disclosed")).where(F.col("disclosed") >= generalise)


@dataclass(frozen=True)
class PiiConfig:
    support: int = 2
    #: Documents that smooth p(e | t).
    smooth: float = 1.0
    generalise: float = 0.7
    remove: float = 0.9
    #: Code points on both sides of an entity that tell one mention from a copy.
    near: int = 40


def _with_row(rows: DataFrame, c: PiiConfig) -> DataFrame:
    """rows (..., base, text where base isn't empty), written, with row, terms and entities."""
    rows = rows.withColumn("terms", F.when(F.size("base") > 0, terms_of(F.col("text")))).withColumn("entities", F.when(F.size("base") > 0, entities(F.col("text"), F.col("base"), c.near)))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pii")


def find_pii(documents: DataFrame, config: PiiConfig | None = None) -> DataFrame:
    """Every row of documents: doc_id, base (spans of the patterns) and spans (base and terms; value of a term: its action).

    Cases: a null text has no spans; very long texts are searched whole; repeated rows get equal spans; ties in place
    go by kind; an empty table gives none; other columns, also ones named like the ones added here, are carried as
    they are by sanitise() and ignored by the digest. A term span that touches a base span is left out.
    """
    c = config or PiiConfig()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("base", base_spans(F.col("text")))
    # the texts without any span need no more than their id
    rows = rows.select("doc_id", F.coalesce("base", F.array().cast(SPAN)).alias("base"), F.when(F.size("base") > 0, F.col("text")).alias("text"))
    return with_terms(_with_row(rows, c), documents, c)


def with_terms(rows: DataFrame, documents: DataFrame, c: PiiConfig) -> DataFrame:
    """rows (row, base, text where base isn't empty, ...) with spans."""
    found = rows.where(F.size("base") > 0)
    terms = materialize(disclosing_terms(found.select("row", "terms", "entities"), documents, c.support, c.smooth, c.generalise), "disclosing-terms")
    # a document's pairs of entity and term that disclose; both are the key, so that a hot entity is many keys
    held = found.select("row", "terms", F.explode("entities.entity").alias("name")).join(_checked(terms.select(F.col("entity").alias("name")).distinct()), "name", "left_semi")
    held = held.select("row", F.col("name").alias("entity"), F.explode("terms").alias("term"))
    acts = held.join(_checked(terms), ["entity", "term"]).groupBy("row", "term").agg(F.max("disclosed").alias("disclosed"))
    acts = acts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", F.when(F.col("disclosed") >= c.remove, "remove").otherwise("generalise")))).alias("acts"))
    some = found.drop("terms", "entities").join(acts.withColumnRenamed("row", "at"), F.col("row") == F.col("at"), "left").drop("at")
    low = lower_ascii(F.col("text"))
    pattern = F.concat(F.lit(rf"(?<!{WORD})(?:"), F.array_join(F.array_sort(F.map_keys("acts")), "|"), F.lit(rf")(?!{WORD})"))
    places = F.when(F.col("acts").isNotNull(), located(low, pattern, "term")).otherwise(F.array().cast(SPAN))
    free = F.filter(places, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    acted = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["kind"].alias("kind"), F.col("acts")[t["value"]].alias("value")))
    some = some.withColumn("spans", by_place(F.concat("base", acted.cast(SPAN)))).drop("acts")
    return some.unionByName(rows.where(F.size("base") == 0).drop("terms", "entities").withColumn("spans", F.col("base")))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pii_digest(documents: DataFrame, config: PiiConfig | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    rows = find_pii(documents, config)
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), _count("spans", "term").alias("n_terms"))


def rewritten(text: Column, spans: Column) -> Column:
    """The text with overlapping spans merged and each run replaced: [EMAIL] etc., [TERM] for a generalised term, nothing for a removed one."""
    label = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "remove", "").otherwise("[TERM]")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), label(s)).alias("out")))
    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def sanitise(documents: DataFrame, config: PiiConfig | None = None) -> DataFrame:
    """The documents with their columns; personal data and disclosing terms in text are replaced, n_chars follows the text.

    Only rows with spans are rewritten; cases as in find_pii.
    """
    c = config or PiiConfig()
    # the row is one column, so that no name of its columns meets those added here
    packed = documents.select(F.struct(*(F.col(f"`{x}`") for x in documents.columns)).alias("doc"))
    packed = packed.withColumn("base", F.coalesce(base_spans(F.col("doc.text").cast("string")), F.array().cast(SPAN)))
    some = packed.where(F.size("base") > 0).select("doc", "base", F.col("doc.text").cast("string").alias("text"))
    done = with_terms(_with_row(some, c), documents, c).withColumn("text", rewritten(F.col("text"), F.col("spans")))
    size = {"n_chars": F.length("text")} if "n_chars" in documents.columns else {}
    back = [(F.col("text") if c == "text" else size.get(c, F.col(f"doc.`{c}`"))).cast(documents.schema[c].dataType).alias(c) for c in documents.columns]
    return done.select(*back).unionByName(packed.where(F.size("base") == 0).select("doc.*"))
