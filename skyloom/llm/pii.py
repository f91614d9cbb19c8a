"""Personal data: fixed patterns, and terms whose company in the corpus gives protected values away.

Everything is column expressions; nothing runs in Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, text_key

# The contract's patterns. Possessive quantifiers and starts at run borders (or where the last match ended) keep the same matches
# and make long runs linear; the counted card pattern finds the runs of 16 digits or more, as shorter ones fail anyway.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
SPAN = "array<struct<start:int,end:int,value:string>>"
LETTERS = r"[^\p{L}\p{N}]+"
CHUNK = 512


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value worked out once, however often ``make`` uses it."""
    return F.transform(F.array(value), make)[0]


def places(text: Column, pattern: Column) -> Column:
    """``(start, end, value)`` of the matches of a pattern in code points: the pieces between the matches give the starts.

    Lengths are added up in chunks of ``CHUNK`` matches and the chunks are
    shifted by the totals before them, so that a text with very many matches
    doesn't copy its list once a match.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.filter(F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("v"), g.alias("g"))), lambda x: x["v"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def span(begin: Column, end: Column, value: Column) -> Column:
        return F.struct(begin.alias("start"), end.alias("end"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.char_length(x["v"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span(begin, end, x["v"]))).alias("out"))

    def shift(acc: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["out"], lambda s: span(s["start"] + acc["at"], s["end"] + acc["at"], s["value"]))
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def summed(all_: Column) -> Column:
        last = F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(all_, b * CHUNK + 1, F.lit(CHUNK)), start, step))
        whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(chunks, whole, shift, lambda acc: F.flatten(acc["out"]))

    return bound(both, summed)


def over(kind: str, make: Callable[[str, Column], Column]) -> Column:
    """``make(kind, span)`` of every span in the column of a kind."""
    return F.transform(F.col(kind), lambda s: make(kind, s))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit is doubled and its digits added."""
    cells = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                        .otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(cells, F.lit(0), lambda a, c: a + c) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.char_length(digits(value)).between(16, 19) & luhn(digits(value))
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """The passing matches of each kind; a text without a kind's characters isn't searched."""
    return {kind: F.when(text.rlike(HINTS[kind]), F.filter(places(text, F.lit(pattern)), lambda s: passes(kind, s["value"])))
            .otherwise(F.array().cast(SPAN)) for kind, pattern in PATTERNS.items()}


def entity(kind: str, value: Column) -> Column:
    """A value's identity, whatever its spelling."""
    plain = F.lower(value) if kind in ("email", "ip") else digits(value)
    return F.concat(F.lit(kind + ":"), plain)


def block(kind: str, value: Column) -> Column:
    """The group that a value belongs to, which many values share: mail domain, address block, issuer of a card, start of a phone number."""
    if kind == "email":
        part = F.lower(F.substring_index(value, "@", -1))
    elif kind == "ip":
        part = F.substring_index(value, ".", 2)
    else:
        part = F.substring(digits(value), 1, 6 if kind == "card" else 4)
    return F.concat(F.lit(f"{kind} block:"), part)


def words(text: Column) -> Column:
    """The lower-cased words with a letter, in order."""
    return F.filter(F.split(F.lower(text), LETTERS), lambda w: w.rlike(r"\p{L}"))


def blanked(text: Column, pattern: str, same_length: bool) -> Column:
    """The text with blanks for the matches of a pattern."""
    if not same_length:
        return F.regexp_replace(text, pattern, " ")
    blanks = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.repeat(F.lit(" "), F.char_length(v)))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")


def without_values(text: Column, same_length: bool = False) -> Column:
    for pattern in PATTERNS.values():
        text = blanked(text, pattern, same_length)
    return text


def company(kind: str, text: Column, reach: int) -> Column:
    """For every passing match of a kind its entities (value and block) and the words within ``reach`` of it, up to the next match of the kind."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def sides(g: Column) -> Column:
        return F.zip_with(found, F.zip_with(g, F.slice(g, F.lit(2), F.size(g)), lambda b, a: F.struct(b.alias("b"), a.alias("a"))),
                          lambda v, s: F.struct(v.alias("v"), s["b"].alias("b"), s["a"].alias("a")))

    own = F.filter(bound(F.split(text, pattern, -1), sides), lambda x: x["v"].isNotNull() & passes(kind, x["v"]))
    return F.transform(own, lambda x: F.struct(
        F.array(entity(kind, x["v"]), block(kind, x["v"])).alias("cs"),
        F.array_distinct(F.concat(F.slice(F.reverse(words(without_values(x["b"]))), 1, reach), F.slice(words(without_values(x["a"])), 1, reach)))
        .alias("ts")))


def disclosing_terms(personal: DataFrame, texts: DataFrame, reach: int, generalise: float) -> DataFrame:
    """``(h, term, strength)``: the terms of each text that give away a protected entity of the same text.

    An entity is a protected value or its block (mail domain, address block,
    card issuer, start of a phone number); a term keeps an entity company where
    it stands within ``reach`` words of one of its values. With counts over the
    N distinct texts, n_c with the entity, n_t with the term anywhere and n_tc
    with the term in the entity's company, a term reveals
    log2(N n_tc / ((n_t + 1) n_c)) of the log2(N / n_c) bits that the entity
    holds; strength is that share. The one in n_t + 1 stands for a text not yet
    seen, so a term that only one text has is strong but never certain. An
    entity that every text has holds no information and is left out.

    Rows grow with the number of values times ``reach``, never with pairs of
    values and terms of a text. The rest of the corpus comes in by term counts
    that are combined before the shuffle.
    """
    n = texts.agg(F.count_distinct("h")).first()[0]
    near = personal.select("h", F.explode(F.concat(*[company(k, F.col("t"), reach) for k in KINDS])).alias("x"))
    near = stored(near.select("h", F.explode("x.cs").alias("c"), F.col("x.ts").alias("ts")), "company")
    held = near.select("h", "c").distinct().groupBy("c").agg(F.count("*").alias("n_c"))
    pairs = near.select("h", "c", F.explode("ts").alias("term")).distinct()
    together = stored(pairs.groupBy("c", "term").agg(F.count("*").alias("n_tc")), "together")  # a table, so that the joins can split a hot entity
    every = (texts.dropDuplicates(["h"]).select(F.explode(F.array_distinct(words(F.col("t")))).alias("term"))
             .select(F.xxhash64("term").alias("w")).groupBy("w").agg(F.count("*").alias("n_w")))
    counts = together.select("term").distinct().withColumn("w", F.xxhash64("term")).join(every, "w", "left").select("term", "n_w")
    judged = together.join(held, "c").join(counts, "term")
    n_t = F.greatest(F.coalesce("n_w", F.lit(0)), F.col("n_tc")) + 1
    information = F.log2(n / F.col("n_c"))
    strength = F.log2(n * F.col("n_tc") / (n_t * F.col("n_c"))) / information
    telling = judged.filter(information > 0).select("c", "term", strength.alias("strength")).filter(F.col("strength") >= generalise)
    return pairs.join(telling, ["c", "term"]).groupBy("h", "term").agg(F.max("strength").alias("strength"))


def find_personal(docs: DataFrame, reach: int = 8, generalise: float = 0.8, remove: float = 0.95, ident: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per document with the personal data of its whole text (null: empty), and the text with it taken out.

    Base spans are e-mail addresses, IP addresses, card and phone numbers. Added
    spans are terms that would still point to a protected value after it is
    taken out: those whose company in the corpus gives away at least
    ``generalise`` of the information of a value or its block (see
    ``disclosing_terms``). Wherever such a term stands in the text outside
    e-mail addresses and numbers, it is replaced by its class (name, code or
    word), from ``remove`` on it is removed. ``spans`` lists all spans by kind
    (email, ip, card, phone, general, removed), then start, in code points with
    the end exclusive. Repeated rows give repeated results; a null identifier
    stays null; an empty table gives an empty one; other columns are not read.
    A very long text is one row like any other: matches cost time in proportion
    to their number, and words are looked up by a join.

    The patterns run once over all texts; distinct texts with personal data are
    stored. Documents get their results by the hash of the text; many copies of
    one such text are split by adaptive execution.
    """
    rows = docs.select(F.col(ident).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"), text_key(text).alias("h"))
    texts = rows.select("h", "t")
    found = texts.withColumns(base_spans(F.col("t"))).filter(F.greatest(*[F.size(k) for k in KINDS]) > 0)
    personal = stored(found.dropDuplicates(["h"]), "personal")
    telling = disclosing_terms(personal, texts, reach, generalise)
    tokens = personal.select("h", F.explode(places(without_values(F.col("t"), True), F.lit(r"[\p{L}\p{N}]+"))).alias("s"))
    marked = tokens.withColumn("term", F.lower("s.value")).join(telling, ["h", "term"]).select("h", "s", "strength")
    weak = F.col("strength") < remove
    added = marked.groupBy("h").agg(F.sort_array(F.collect_list(F.when(weak, F.col("s")))).alias("general"),
                                    F.sort_array(F.collect_list(F.when(~weak, F.col("s")))).alias("removed"))
    nothing = F.array().cast(SPAN)
    with_terms = personal.join(added, "h", "left").withColumns({c: F.coalesce(F.col(c), nothing) for c in ("general", "removed")})

    def spelled(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.concat(*[over(k, lambda kind, s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))) for k in kinds]), ",")

    def shown(kind: str, s: Column) -> Column:
        as_class = (F.when(s["value"].rlike(r"\p{N}"), F.lit("<code>")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("<name>"))
                    .otherwise(F.lit("<word>")))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (as_class if kind == "general" else F.lit(f"<{kind}>")).alias("as_"))

    in_order = F.array_sort(F.concat(*[over(k, shown) for k in (*KINDS, "general", "removed")]))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    sanitised = F.aggregate(in_order, begin, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, s["start"] - a["at"]), s["as_"]).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, F.char_length("t"))))
    results = stored(with_terms.select("h", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                                       (F.size("general") + F.size("removed")).cast("long").alias("n_terms"),
                                       F.sha2(spelled(KINDS), 256).alias("base_sha256"), spelled((*KINDS, "general", "removed")).alias("spans"),
                                       sanitised.alias("sanitised")), "sanitised")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in (*KINDS, "terms")]
    return rows.join(results, "h", "left").select(
        F.col("d").alias("doc_id"), *counts, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("sanitised", "t").alias("sanitised"))
