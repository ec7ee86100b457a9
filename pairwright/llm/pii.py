"""Personal data: fixed formats, and terms that give protected entities away by how they co-occur in the corpus.

All of it is DataFrame functions; nothing runs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut, small, text_key, unused
from pairwright.llm.spans import SPAN, blanked, bound, find_spans, joined, merged, replaced, running

KINDS = ("email", "ip", "card", "phone")
#: Stands for a dot or separator inside a name or number, so that one character class covers repeated groups; a regular
#: expression with a repeated group would recurse on very long matches.
INNER = "\x01"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{INNER}-])|\G)[A-Za-z0-9._%+{INNER}-]++@[A-Za-z0-9-]+{INNER}[A-Za-z0-9{INNER}-]*"
IP = r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = rf"[0-9][0-9{INNER}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NO_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def _inner(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.translate(text, INNER, "\x02"), pattern, INNER)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the four fixed formats."""
    email = find_spans(_inner(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"), EMAIL, F.contains(text, F.lit("@")))
    ip = find_spans(text, IP, text.rlike(r"[0-9]\.[0-9]"))
    card = find_spans(_inner(text, r"(?<=[0-9])[\x20-](?=[0-9])"), CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    phone = find_spans(text, PHONE, F.contains(text, F.lit("+")))

    def small(part: Column) -> Column:
        number = F.ltrim(part, F.lit("0"))
        return F.when(F.length(number) <= 3, F.concat(F.lit("0"), number).cast("int") <= 255).otherwise(False)

    return {
        "email": email,
        "ip": F.filter(ip, lambda x: F.forall(F.split(x["value"], "[.]"), small)),
        "card": F.filter(card, lambda x: F.when(F.length(_digits(x["value"])).between(14, 19), _luhn(x["value"])).otherwise(False)),
        "phone": F.filter(phone, lambda x: F.length(_digits(x["value"])).between(10, 15)),
    }


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _outside(text: Column) -> Column:
    """The lower-cased text without what the fixed formats' spans hold; offsets stay."""
    return _lower(blanked(text, [F.col(k) for k in KINDS]))


def _near(text: Column, reach: int) -> Column:
    """For every mention its entity and the ``reach`` words before and behind it, by their places among all words."""

    def places(x: Column) -> Column:
        words = F.transform(x["words"], lambda w: F.struct(w["start"].alias("at"), F.lit(1).alias("word"), F.lit("").alias("entity")))
        # an entity is what is found without separators
        said = F.transform(x["spans"], lambda m: F.struct(m["start"].alias("at"), F.lit(0).alias("word"), _lower(F.regexp_replace(m["value"], r"[\x20()-]", "")).alias("entity")))
        return bound(F.struct(F.array_sort(F.concat(words, said)).alias("events"), F.transform(x["words"], lambda w: w["value"]).alias("values")), around)

    def around(x: Column) -> Column:
        before = F.zip_with(x["events"], running(F.transform(x["events"], lambda e: e["word"]), lambda a, b: a + b), lambda e, n: F.struct(e["word"].alias("word"), e["entity"].alias("entity"), n.alias("n")))
        first = lambda m: F.greatest(m["n"] - reach + 1, F.lit(1))
        return F.transform(F.filter(before, lambda e: e["word"] == 0), lambda m: F.struct(m["entity"].alias("entity"), F.slice(x["values"], first(m), m["n"] + reach - first(m) + 1).alias("terms")))

    return bound(F.struct(find_spans(_outside(text), f"[^{NO_WORD}]+", F.lit(True)).alias("words"), F.concat(*KINDS).alias("spans")), places)


def disclosing_terms(found: DataFrame, reach: int = 10, support: int = 5, least_chars: int = 4, generalise: float = 0.5, bits: float = 3.0, most_broadcast: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(term, share) of the terms that give a protected entity away, and (t, term): which texts hold them.

    ``found`` has text and the spans of the fixed formats; t is ``text_key(text)``. Terms are words of at least
    ``least_chars`` characters outside those spans. A term co-occurs with an entity where it is one of the ``reach`` words
    before or behind a mention, all words outside the spans counted. share is P(entity | term): of the different texts
    that hold the term, those in which it co-occurs with the entity, for the entity that it reveals most. A term counts if
    it does so in at least ``support`` different texts, its share is at least ``generalise``, and the entity is at least
    ``bits`` bits likelier beside the term than anywhere. A term with equal shares for several entities has that share.
    Equal texts count once, so copying a document proves nothing. All counts cover all rows and are exact. Up to
    ``most_broadcast`` candidates are looked up by a broadcast join, more by a shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = found.where(F.size(F.concat(*KINDS)) > 0)
    each = rows.select(text_key("text").alias("t"), F.explode(_near(text, reach)).alias("x")).select("t", "x.entity", F.explode(F.array_distinct("x.terms")).alias("term"))
    pairs = cut(each.where((F.length("term") >= least_chars) & ~F.contains("entity", F.col("term"))).distinct())
    # a term stands in at least as many texts as it stands beside any entity in, which rules out most common words
    beside = cut(pairs.select("t", "term").distinct().groupBy("term").agg(F.count("*").alias("n_beside")).where(F.col("n_beside") >= support))
    together = pairs.groupBy("term", "entity").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    together = cut(together.join(beside, "term").where(F.col("n_both") >= generalise * F.col("n_beside")).drop("n_beside"))
    if together.limit(1).count() == 0:
        return together.select("term", F.lit(1.0).alias("share")).limit(0), pairs.select("t", "term").limit(0)
    entities = rows.select(text_key("text").alias("t"), F.explode(F.transform(F.concat(*KINDS), lambda x: _lower(F.regexp_replace(x["value"], r"[\x20()-]", "")))).alias("entity")).distinct()
    entities = entities.groupBy("entity").agg(F.count("*").alias("n_entity"))
    n_texts = found.select(text_key("text")).distinct().count()
    words = F.filter(F.array_distinct(F.split(_outside(text), f"[{NO_WORD}]+")), lambda w: F.length(w) >= least_chars)
    asked = small(together.select("term").distinct(), most_broadcast)
    holding = cut(found.select(text_key("text").alias("t"), F.explode(words).alias("term")).join(asked, "term", "left_semi").distinct())
    counts = holding.groupBy("term").agg(F.count("*").alias("n_term"))
    share = F.col("n_both") / F.greatest("n_term", "n_both")
    gain = F.log2(share * F.lit(float(max(n_texts, 1))) / F.col("n_entity"))
    scored = together.join(counts, "term").join(entities, "entity").where((share >= generalise) & (gain >= bits))
    terms = small(scored.groupBy("term").agg(F.max(share).alias("share")), most_broadcast)
    return terms, holding.join(terms, "term", "left_semi")


def looked_up(words: Column, terms: Column) -> Column:
    """(start, end, value, revealing) of the words (start, end, value) that are among the terms (term, revealing), by start.

    Words and terms are sorted together, so that each word comes behind its term, however many there are of either.
    """
    every = F.concat(F.transform(terms, lambda x: F.struct(x["term"].alias("v"), F.lit(-1).alias("s"), x["revealing"].alias("e"))), F.transform(words, lambda w: F.struct(w["value"].alias("v"), w["start"].alias("s"), w["end"].alias("e"))))

    def matched(x: Column) -> Column:
        both = F.zip_with(x["events"], x["terms"], lambda e, k: bound(F.struct(e.alias("e"), F.get(x["events"], k).alias("t")), lambda y: F.when((y["e"]["s"] >= 0) & (y["t"]["s"] < 0) & (y["t"]["v"] == y["e"]["v"]), F.struct(y["e"]["s"].alias("start"), y["e"]["e"].alias("end"), y["e"]["v"].alias("value"), y["t"]["e"].alias("revealing")))))
        return F.array_sort(F.array_compact(both))

    # the place of the last term before each word, or of the word itself
    behind = lambda v: running(F.transform(v, lambda x, i: F.when(x["s"] < 0, i).otherwise(0)), lambda a, b: F.greatest(a, b))
    return bound(F.array_sort(every), lambda v: bound(F.struct(v.alias("events"), behind(v).alias("terms")), matched))


def private_spans(docs: DataFrame, remove: float = 0.8, **thresholds: float) -> DataFrame:
    """Adds email, ip, card, phone, term and revealing (arrays of start, end, value) to every row of ``docs`` (text).

    term: words to be generalised; revealing: words to be removed, whose share is at least ``remove``; see
    ``disclosing_terms``. Such words are found wherever they stand, with or without the entity, but for inside the fixed
    formats' spans. A null text has no spans; rows are kept as they are, repeated ones too, and equal texts have equal
    spans; other columns stay and those of the six names are replaced. The terms are a table that is joined with the
    texts' words, so nothing of it passes the driver.
    """
    new = [*KINDS, "term", "revealing"]
    base = docs.drop(*new)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = base.withColumns(base_spans(text))
    terms, holding = disclosing_terms(found, **thresholds)
    hits, key = unused(docs, "hits"), unused(docs, "key")
    # what one text holds of the terms is no more than its different words
    held = holding.join(terms, "term").groupBy("t").agg(F.collect_list(F.struct("term", (F.col("share") >= remove).cast("int").alias("revealing"))).alias(hits))
    out = found.withColumn(key, text_key("text")).join(small(held.withColumnRenamed("t", key)), key, "left").drop(key)
    words = find_spans(_outside(text), f"[^{NO_WORD}]+", F.col(hits).isNotNull())
    out = out.withColumn(hits, F.when(F.col(hits).isNotNull(), looked_up(words, F.col(hits))))
    told = lambda yes: F.transform(F.filter(hits, lambda x: x["revealing"] == int(yes)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    none = F.from_json(F.lit("[]"), SPAN)
    return out.withColumns({"term": F.coalesce(told(False), none), "revealing": F.coalesce(told(True), none)}).select(*base.columns, *new)


def sanitised(found: DataFrame) -> DataFrame:
    """The rows with text cleaned: fixed formats and generalised terms give way to their kind, revealing terms go."""
    marks = [*((f"[{k.upper()}]", F.col(k)) for k in KINDS), ("[TERM]", F.col("term")), ("", F.col("revealing"))]
    return found.withColumn("text", replaced(F.col("text"), merged(marks))).drop(*KINDS, "term", "revealing")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of the fixed formats' spans, their digest, and all spans as text."""
    base = [(k, F.col(k)) for k in KINDS]
    return found.select("doc_id", *(F.size(c).cast("long").alias(f"n_{k}") for k, c in base), F.sha2(joined(base), 256).alias("base_sha256"), joined([*base, ("term", F.col("term")), ("revealing", F.col("revealing"))]).alias("spans"))
