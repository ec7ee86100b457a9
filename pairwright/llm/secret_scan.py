"""Secret scan: fixed formats, and character Markov models of random strings against ordinary identifiers.

All of it is DataFrame functions; nothing runs Python on the executors.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import cut, sample_by_id
from pairwright.llm.spans import blanked, bound, find_spans, joined, merged, replaced

# Fixed formats.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Names by its format what it is, so it is no secret.
UUID = r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9])"

#: Classes of characters: a-z, A-Z, 0-9, then + / _ = -; a bigram is one of N * N cells.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
N = len(ALPHABET)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the three fixed formats."""
    assign = find_spans(text, ASSIGN, text.rlike("[:=]"))
    return {
        "assign": F.filter(assign, lambda x: F.length(F.regexp_replace(x["value"], ASSIGN_HEAD, "")) >= 12),
        "access": find_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": find_spans(text, HEX, text.rlike(HEX)),
    }


def _codes(token: Column) -> Column:
    """The places of a token's characters in the alphabet, from 0."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _bigrams(token: Column) -> Column:
    codes = _codes(token)
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: a * N + b)


def _identifiers(text: Column, every: int = 8) -> Column:
    """Identifiers as they are made of words: every ``every``th run of two to four of the text's words, as snake_case,
    kebab-case, a path, camelCase, a class name, a constant, or with numbers, dates or times; a hash tells which."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))

    def made(run: Column, at: Column) -> Column:
        spaced, pick = F.array_join(run, " "), F.xxhash64(F.array_join(run, "|"), at)
        title, few = F.replace(F.initcap(spaced), F.lit(" "), F.lit("")), F.pmod(F.shiftright(pick, 8), F.lit(100)).cast("string")
        by = lambda sign: F.replace(spaced, F.lit(" "), F.lit(sign))
        two = lambda shift, most: F.lpad(F.pmod(F.shiftright(pick, shift), F.lit(most)).cast("string"), 2, "0")
        date = F.concat(F.lit("20"), few2 := F.lpad(few, 2, "0"), F.lit("-"), two(16, 12), F.lit("-"), two(24, 31))
        numbers = F.concat_ws("-", F.get(run, 0), few2, two(16, 100), two(24, 60), two(32, 100))
        stamp = F.concat(date, F.lit("T"), two(32, 24), F.lit("-"), two(40, 60), F.lit("-"), two(48, 60), F.lit("Z-"), F.get(run, 0))
        port = F.concat(F.get(run, 0), F.lit("/"), two(16, 100), two(24, 100), F.lit("-to-"), few, F.lit("-"), two(32, 10), F.lit("-"), two(40, 100), F.lit("-"), two(48, 10), F.lit("/"), few)
        forms = [F.concat(by("-"), F.lit("-"), date), stamp, numbers, port, F.concat(date, F.lit("/"), by("/")), by("_"), by("-"), by("/"), F.concat(F.lower(F.substring(title, 1, 1)), F.substring(title, 2, 200)), title, F.upper(by("_")), F.concat(F.get(run, 0), F.substring(few, 1, 1), F.lit("/"), by("-")), F.concat(by("_"), F.lit("_"), few), F.concat(by("-"), F.lit("-20"), F.lpad(few, 2, "0")), F.concat(F.lit("/"), by("/"), F.lit("/v"), few)]
        return F.get(F.array(*forms), F.pmod(pick, F.lit(len(forms))).cast("int"))

    def over(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(every)), lambda i: i < F.size(w))
        return F.transform(starts, lambda i: made(F.slice(w, i, F.pmod(F.xxhash64(i, F.get(w, i - 1)), F.lit(3)).cast("int") + 2), i))

    return bound(words, over)


# Characters in their order, which make no secret.
IN_ORDER = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789", "qwertyuiopasdfghjklzxcvbnm", "================", "----------------", "________________", "++++++++++++++++", "////////////////")

# Labelled samples: words that identifiers are often made of, whatever the corpus is about.
PARTS = (
    "account action address admin api app archive array asset async audio author backup batch binary block body branch buffer build button byte cache call camera card channel char chart check child class click client clock "
    "code column command comment common config connection console constant contact content context copy count create cursor customer data date debug default delete detail device dialog directory document download driver "
    "element email engine entity entry error event export field file filter folder format frame function global graph group handle header hidden history image import index info input instance interface item key label language layout level "
    "library link load local logger loop map memory menu message method mode month name network node notify number object offset option output package page param path payment picture pixel player plugin point policy position print process product profile query queue"
).split()

# Labelled samples: names of people as they are written in several languages, without marks.
NAMES = (
    "abdulrahman adriaansen aleksandrowicz andreasdottir arvidsson athanasiadis bartholomew bialystok brzeczyszczykiewicz chrzanowski csikszentmihalyi dostoevsky dvorakova echeverria eriksson featherstonehaugh "
    "fitzgerald gianfranco giovannini goncalves grzegorz guadalupe gunnarsson hakkarainen hernandez hrvatska ibrahimovic ilmarinen jedrzejczyk johannsson juhaszova kaczmarek katarzyna khrushchev kowalczyk krzysztof "
    "kwasniewski lindqvist lukaszewicz maciejewski magnusdottir mbappe mkhitaryan mohammed muhammadu ngozi nguyen nkrumah oluwaseun papadopoulos pietrzak przemyslaw quetzalcoatl rodriguez rzeszow schwarzenegger "
    "shevchenko sigurdsson szczepanski szymborska tchaikovsky thorvaldsen tsiolkovsky uzoamaka vaclavik vandenberg wawrzyniak weissmuller wojciechowski xochitl yevgeniy yordanov zbigniew zsigmond zwolinski"
).split()


def labelled_tokens(docs: DataFrame, most_docs: int = 2000, most_chars: int = 65_536) -> DataFrame:
    """(token, random): samples to train from, of at most ``most_docs`` documents of at most ``most_chars``, picked by the
    hash of their ids.

    Ordinary: the documents' runs of 4 or more letters, identifiers made of their words and of ``PARTS`` and ``NAMES`` in an
    order drawn for each document, and characters in their order.
    Random: what the fixed formats find in them, and for each document the hex and base64 forms of digests of its id and
    text. Repeated documents and tokens count as often as they occur.
    """
    picked = sample_by_id(docs.where(F.length("text") <= most_chars), "doc_id", "text", most_docs)
    # so few rows would be read by one task or two
    picked = cut(picked.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, 8), F.xxhash64("doc_id")))
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    # neighbours in an order drawn for each document: steps through the parts, whose number is prime to every step below it
    every = [*PARTS, *NAMES]
    n = next(k for k in range(len(every), 1, -1) if all(k % d for d in range(2, int(k**0.5) + 1)))
    step, first = F.pmod(F.xxhash64("doc_id"), F.lit(n - 1)) + 1, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(n))
    parts = bound(F.split(F.lit(" ".join(every)), " "), lambda w: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(w, F.pmod(first + step * i, F.lit(n)).cast("int"))), " "))
    ordinary = picked.select(F.explode(F.concat(words, _identifiers(F.col("text")), _identifiers(parts), F.array(*(F.lit(x) for x in IN_ORDER)))).alias("token"), F.lit(False).alias("random"))
    base = base_spans(F.col("text"))
    found = picked.select(F.explode(F.concat(F.transform(base["assign"], lambda x: F.regexp_replace(x["value"], ASSIGN_HEAD, "")), *(F.transform(base[k], lambda x: x["value"]) for k in ("access", "hex")))).alias("token"))
    seed = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    made = picked.select(F.explode(F.array(F.sha1(seed), F.base64(F.unhex(F.sha2(seed, 256))), F.base64(F.unhex(F.sha2(seed, 384))), F.md5(seed), F.upper(F.sha2(seed, 224)))).alias("token"))
    return ordinary.unionByName(found.unionByName(made).select(F.regexp_replace("token", "[^A-Za-z0-9+/_=-]", "").alias("token"), F.lit(True).alias("random")))


class Model(NamedTuple):
    """The log-likelihood ratio of each bigram, random over ordinary (N * N numbers), and the least sum of a secret."""

    cells: list[float]
    threshold: float


def held_back(token: Column) -> Column:
    """True for the fifth of the samples that only the threshold is set from; fixed ones aren't among them."""
    return (F.pmod(F.xxhash64(token), F.lit(5)) == 0) & ~token.isin(*IN_ORDER)


def train(tokens: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each bigram, random over ordinary; N * N numbers.

    ``tokens``: (token, random). Each model is a first-order chain with added ``smoothing``. Equal tokens are counted before
    their bigrams are.
    """
    tokens = tokens.where(F.length("token") >= 2).groupBy("random", "token").agg(F.count("*").alias("n"))
    counts = tokens.select("random", "n", F.explode(_bigrams(F.col("token"))).alias("cell")).groupBy("random", "cell").agg(F.sum("n"))
    seen = {(r[0], r[1]): r[2] for r in counts.collect()}  # at most 2 * N * N rows
    out = []
    for a in range(N):
        totals = [sum(seen.get((k, a * N + b), 0) for b in range(N)) + smoothing * N for k in (True, False)]
        out += [math.log((seen.get((True, a * N + b), 0) + smoothing) / totals[0]) - math.log((seen.get((False, a * N + b), 0) + smoothing) / totals[1]) for b in range(N)]
    return out


def ratio(token: Column, cells: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's bigrams: over 0 if the random model explains it better."""
    each = F.split(F.lit(",".join(f"{x:.6f}" for x in cells)), ",").cast("array<double>")
    return F.aggregate(_bigrams(token), F.lit(0.0), lambda s, c: s + F.get(each, c)) / F.greatest(F.length(token) - 1, F.lit(1))


#: What each bigram must exceed to make a stretch look more random; how far a stretch may fall behind its best before it
#: ends; the least mean of its bigrams above ``DRIFT``; and the least characters of a secret.
DRIFT, FALL, LEAST_MEAN, LEAST_CHARS = 0.4, 14.0, 0.6, 16
SEGMENT = "array<struct<from:int,to:int,top:double>>"


def stretches(token: Column, cells: list[float], least_chars: int = LEAST_CHARS) -> Column:
    """The stretches of a token (from, to, top) that look random, and how much by.

    The ratios of the bigrams, less ``DRIFT``, are summed from where they begin to be positive; a stretch ends at its highest
    sum, once the sum is back at zero or ``FALL`` below that. So ordinary text before or behind a random string takes nothing
    from it. Stretches under ``least_chars`` are left out, and so are long ones that are but a little above zero all along. One pass with a state of fixed size, but for what is found.
    """
    each = F.split(F.lit(",".join(f"{x - DRIFT:.6f}" for x in cells)), ",").cast("array<double>")
    state = lambda i, total, start, top, end, found: F.struct(i.alias("i"), total.alias("sum"), start.alias("from"), top.alias("top"), end.alias("to"), found.alias("found"))

    def told(a: Column) -> Column:
        long = (a["top"] > 0) & (a["to"] - a["from"] >= least_chars) & (a["top"] >= LEAST_MEAN * (a["to"] - a["from"] - 1))
        return F.when(long, F.array_append(a["found"], F.struct(a["from"].alias("from"), a["to"].alias("to"), a["top"].alias("top")))).otherwise(a["found"])

    def step(a: Column, cell: Column) -> Column:
        now, i = a["sum"] + F.get(each, cell), a["i"]
        ends = (now <= 0) | (now < a["top"] - FALL)
        fresh = state(i + 1, F.lit(0.0), i + 1, F.lit(0.0), i + 1, told(a))
        return F.when(ends, fresh).otherwise(state(i + 1, now, a["from"], F.greatest(a["top"], now), F.when(now > a["top"], i + 2).otherwise(a["to"]), a["found"]))

    begin = state(F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), F.from_json(F.lit("[]"), SEGMENT))
    return F.aggregate(_bigrams(token), begin, step, told)


def whole(token: Column, x: Column) -> Column:
    """(start, end) of a stretch with the rest of its part of the token, if that is short: up to 8 letters and digits to the next
    sign, up to 5 characters to the token's end, and padding."""
    before, behind = F.substring(token, F.lit(1), x["from"]), F.substring(token, x["to"] + 1, F.length(token))
    back = F.when(x["from"] <= 5, x["from"]).otherwise(F.length(F.regexp_extract(before, r"(?<![A-Za-z0-9])[A-Za-z0-9]{0,8}$", 0)))
    ahead = F.when(F.length(behind) <= 5, F.length(behind)).otherwise(F.length(F.regexp_extract(behind, r"^[A-Za-z0-9]{0,8}(?![A-Za-z0-9])=*", 0)))
    return F.struct((x["from"] - back).alias("start"), (x["to"] + ahead).alias("end"))


def secret_model(tokens: DataFrame, false_alarms: float = 0.002, missed: float = 0.02, least: float = 8.0) -> Model:
    """A model of labelled ``tokens`` (token, random), of which a fifth sets the threshold.

    Of held-back tokens of 16 or more characters the most random stretch counts, of random ones that of their first 16 to 23
    characters. The threshold lies midway between what a share of ``false_alarms`` of the ordinary ones exceed and what a
    share of ``missed`` of the random ones stay below, and is no less than ``least``, which also holds where there is nothing
    to learn from.
    """
    cells = train(tokens.where(~held_back(F.col("token"))))
    short = F.substring(F.col("token"), F.lit(1), (F.pmod(F.xxhash64("token"), F.lit(8)) + 16).cast("int"))
    token = F.when(F.col("random"), short).otherwise(F.col("token"))
    top = F.coalesce(F.array_max(F.transform(stretches(token, cells, 2), lambda x: x["top"])), F.lit(0.0))
    kept = tokens.where(held_back(F.col("token")) & (F.length("token") >= 16)).select("random", top.alias("r"))
    # the sample is bounded, so its percentiles are
    high, low = kept.agg(F.percentile(F.when(~F.col("random"), F.col("r")), F.lit(1 - false_alarms)), F.percentile(F.when(F.col("random"), F.col("r")), F.lit(missed))).collect()[0]
    return Model(cells, max(least, (high + low) / 2) if high is not None and low is not None else least)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Adds assign, access, hex and markov (arrays of start, end, value) to every row of ``docs`` (text).

    markov: stretches of 16 or more characters of the alphabet, in what the fixed formats' spans and UUIDs leave of the text,
    whose summed log-likelihood ratio is over the model's threshold, with the rest of their part (``whole``); shorter random strings are never secrets, as
    they can't be told from abbreviations and numbers. A null text has no spans; rows are kept as they are,
    repeated ones too, and equal texts have equal spans; other columns stay and those of the four names are replaced.
    """
    base = docs.drop("assign", "access", "hex", "markov")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = base.withColumns(base_spans(text))
    left = F.regexp_replace(blanked(text, [F.col(k) for k in ("assign", "access", "hex")]), UUID, " " * 36)
    long = F.when(text.rlike(CANDIDATE), left).otherwise("")

    def inside(x: Column) -> Column:
        random = F.transform(F.filter(stretches(x["value"], model.cells), lambda r: r["top"] > model.threshold), lambda r: whole(x["value"], r))
        return F.transform(random, lambda r: F.struct((x["start"] + r["start"]).alias("start"), (x["start"] + r["end"]).alias("end"), F.substring(x["value"], r["start"] + 1, r["end"] - r["start"]).alias("value")))

    return found.withColumn("markov", F.flatten(F.transform(find_spans(long, CANDIDATE, text.rlike(CANDIDATE)), inside)))


def secret_spans(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``scan`` with a model trained from ``labelled`` tokens, by default those of ``labelled_tokens(docs)``."""
    return scan(docs, secret_model(cut(labelled_tokens(docs) if labelled is None else labelled)))


def redacted(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The scanned rows with every secret in text replaced by ``mark``; the span columns are dropped."""
    kinds = ["assign", "access", "hex", "markov"]
    text = replaced(F.col("text"), merged([(mark, F.col(k)) for k in kinds]))
    return found.withColumn("text", text).drop(*kinds)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of the fixed formats' spans, their digest, and all spans as text."""
    base = [(k, F.col(k)) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *(F.size(c).cast("long").alias(f"n_{k}") for k, c in base), F.sha2(joined(base), 256).alias("base_sha256"), joined([*base, ("markov", F.col("markov"))]).alias("spans"))
