"""Secret scans: fixed rules, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, materialize, sample_order

ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A match of these two that is too short leaves nothing behind that could match, so the least length may stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Kinds in the order of ties, with their pattern, the group whose length counts, and the least length.
RULES = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: What the models look at: whole runs of these signs; the least length comes behind.
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]"
#: Matches that are numbered in one step; arrays grow by no more than that many at a time.
STEP = 256
#: Signs of the models; anything else is the last one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIGNS = len(ALPHABET) + 1


def numbered(parts: Column) -> Column:
    """array<struct<start, end, s, ok>> of the matches in ``parts``, an array of struct<g, n, s, ok>: the signs before a match and in it.

    Each match needs the signs of all before it. Arrays are copied when they grow, so steps of STEP are summed on
    their own and then shifted: the time grows with the matches, not with their square.
    """

    def summed(step: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,s:string,ok:boolean>>").alias("found"))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["g"]
            span = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["s"].alias("s"), x["ok"].alias("ok"))
            found = F.when(F.coalesce(x["ok"], F.lit(False)), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
            return F.struct((start + F.coalesce(x["n"], F.lit(0))).alias("at"), found.alias("found"))

        return F.aggregate(step, none, add)

    def shifted(steps: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        sums = F.aggregate(steps, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))["before"]
        return F.zip_with(
            steps,
            sums,
            lambda x, at: F.transform(x["found"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["s"].alias("s"), m["ok"].alias("ok"))),
        )

    def cut(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(p) - 1, F.lit(0)) / STEP).cast("int")), lambda i: summed(F.slice(p, i * STEP + 1, STEP)))

    # An array of one binds a value to a name, so that it is made once and not for each use.
    steps = F.transform(F.array(parts), cut)
    return F.flatten(F.element_at(F.transform(steps, shifted), 1))


def matches(text: Column, pattern: str, group: int, least: int, quick: Column | None = None) -> Column:
    """array<struct<start, end, s, ok>> of the leftmost non-overlapping matches whose ``group`` has ``least`` signs or more.

    Positions are code points, ends exclusive. The gaps between matches are what ``split`` leaves;
    texts that fail ``quick`` are not split.
    """
    p = F.lit(pattern)
    whole, part = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    of_match = F.zip_with(whole, part, lambda m, g: F.struct(m.alias("s"), (F.char_length(g) >= least).alias("ok")))
    parts = F.zip_with(
        F.split(text, pattern, -1), of_match, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m["s"]).alias("n"), m["s"].alias("s"), m["ok"].alias("ok"))
    )
    none = F.array().cast("array<struct<start:int,end:int,s:string,ok:boolean>>")
    return F.when(quick if quick is not None else F.lit(True), numbered(parts)).otherwise(none)


def tagged(found: Column, pos: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(pos).alias("pos"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["s"].alias("s")))


def signs(s: Column) -> Column:
    """1-based codes of the signs of a string."""
    return F.transform(F.split(s, ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(F.lit(SIGNS)))


def bigrams(s: Column) -> Column:
    """0-based codes of the pairs of neighbouring signs."""
    return pairs_of(signs(s))


def pairs_of(c: Column) -> Column:
    return F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: (a - 1) * SIGNS + b - 1)


def first_texts(docs: DataFrame, documents: int) -> DataFrame:
    """(text): the ``documents`` texts first in a fixed hash order of ids, then texts; rows alike count once.

    The order is settled on hashes; only texts up to the last chosen one are read after that.
    """
    keyed = docs.where(F.col("text").isNotNull()).select("text", sample_order().alias("_o"), F.xxhash64("text").alias("_h"))
    bound = keyed.select("_o", "_h").orderBy("_o", "_h").limit(documents).agg(F.max(F.struct("_o", "_h")).alias("m")).head()["m"]
    if bound is None:
        return keyed.select("text")
    return keyed.where(F.struct("_o", "_h") <= F.struct(F.lit(bound["_o"]).alias("_o"), F.lit(bound["_h"]).alias("_h"))).groupBy("_o", "_h").agg(F.max("text").alias("text")).select("text")


def labelled_samples(docs: DataFrame, documents: int = 2000, strings: int = 4000) -> DataFrame:
    """(s, random): labelled samples for the models, both bounded by parameters.

    Random ones are ``strings`` digests, cut from base64, base-36-like and hexadecimal spellings of
    hashes of a counter. Ordinary ones are identifiers spelled from the words of the ``documents``
    texts first in a fixed hash order: words alone, in snake_case, in kebab-case with a number, in
    CamelCase, and paths.
    """
    n = docs.sparkSession.range(strings).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "=", "")
    random = n.select(F.when(F.col("id") % 4 == 0, "hex").when(F.col("id") % 4 == 1, "HEX").when(F.col("id") % 4 == 2, "b64").otherwise("B36").alias("k"), "h", b64.alias("b"))
    random = random.select(F.when(F.col("k") == "hex", F.substring("h", 1, 40)).when(F.col("k") == "HEX", F.upper(F.substring("h", 1, 40))).when(F.col("k") == "b64", F.substring("b", 1, 40)).otherwise(F.upper(F.substring("b", 1, 24))).alias("s"))
    first = first_texts(docs, documents)
    words = F.filter(F.split(F.col("text"), "[^A-Za-z]+"), lambda w: F.char_length(w) > 1)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w, v: F.struct(w.alias("w"), F.coalesce(v, F.lit("x")).alias("v")))
    pair = first.select(F.posexplode(pairs).alias("i", "p")).select("i", "p.w", "p.v")
    v = F.col("v")
    ordinary = pair.select(
        F.when(F.col("i") % 5 == 0, F.concat_ws("_", F.lower("w"), F.lower(v)))
        .when(F.col("i") % 5 == 1, F.concat(F.initcap("w"), F.initcap(v)))
        .when(F.col("i") % 5 == 2, F.concat(F.lower("w"), F.lit("-"), F.lower(v), F.lit("-"), (F.col("i") % 100).cast("string")))
        .when(F.col("i") % 5 == 3, F.concat(F.lit("/"), F.lower("w"), F.lit("/"), F.lower(v)))
        .otherwise(F.when(F.col("i") % 10 == 4, F.upper(F.concat_ws("_", "w", v))).otherwise(F.col("w")))
        .alias("s")
    )
    # Numbers (dates, card and phone numbers) are ordinary too.
    numbers = n.select(F.concat_ws("-", F.conv(F.substring("h", 1, 8), 16, 10), F.conv(F.substring("h", 9, 8), 16, 10)).alias("s"))
    return random.select("s", F.lit(True).alias("random")).unionByName(ordinary.unionByName(numbers).select("s", F.lit(False).alias("random")))


class MarkovModels:
    """First-order models of both kinds of strings, as thousandths of a nat of log-likelihood ratio by pair of signs."""

    def __init__(self, ratios: list[int]):
        self.ratios = ratios

    def column(self) -> Column:
        """The ratios as one constant array; the text form keeps the plan small and is folded when it is optimized."""
        return F.split(F.lit(",".join(map(str, self.ratios))), ",").cast("array<int>")

    def llr(self, s: Column) -> Column:
        ratios = self.column()
        return F.aggregate(bigrams(s), F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(ratios, b + 1))


def train(samples: DataFrame, smoothing: float = 0.5) -> MarkovModels:
    """Counts pairs of signs in both kinds; P(next | sign) with additive smoothing. The driver sees SIGNS**2 counts."""
    from math import log

    coded = samples.where(F.col("s").isNotNull()).select("random", F.inline(F.array(F.struct(signs(F.col("s")).alias("c")))))
    counts = coded.select("random", F.explode(pairs_of(F.col("c"))).alias("b")).groupBy("b").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    found = {r["b"]: (r["r"], r["o"]) for r in counts.collect()}
    ratios = []
    for a in range(SIGNS):
        row = [found.get(a * SIGNS + b, (0, 0)) for b in range(SIGNS)]
        r, o = sum(x for x, _ in row), sum(x for _, x in row)
        for x, y in row:
            ratios.append(round(1000 * log((x + smoothing) / (r + smoothing * SIGNS) * (o + smoothing * SIGNS) / (y + smoothing))))
    return MarkovModels(ratios)


def scan(docs: DataFrame, models: MarkovModels, least_signs: int = 16, least_ratio: int = 500, least_sum: int = 9500, keep: list[str] | None = None) -> DataFrame:
    """Adds to the columns ``keep`` (default: all): base and markov, the spans of secrets in the whole text.

    ``base`` holds the matches of RULES; ``markov`` the runs of CANDIDATE signs, ``least_signs`` long
    or more, that overlap no base span and whose log-likelihood ratio is ``least_ratio`` thousandths
    of a nat a pair or more and ``least_sum`` in all, so that a shorter run must be the more random. Both are array<struct<start, pos, end, kind,
    s>> by start, then kind; positions are code points, ends exclusive. Null and empty texts have no
    span, rows that repeat are scanned each, an empty table gives none; an input column named base or markov is replaced. Only built-in functions are used, in one pass without a shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "markov")]
    text, text_name = F.coalesce(F.col("text"), F.lit("")), free_name(docs, "_whole_text")
    quick = {"assign": text.rlike("[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"), "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike("[0-9a-f]{24}")}
    spans = None
    for pos, (kind, pattern, group, least) in enumerate(RULES):
        own = tagged(matches(text, pattern, group, least, quick[kind]), pos, kind)
        spans = own if spans is None else F.concat(spans, own)
    # Spans come out of generators, so that they are found once and not again for each use.
    based = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias(text_name), F.inline(F.array(F.struct(F.array_sort(spans).alias("base")))))
    whole = F.col(text_name)
    candidate = f"{CANDIDATE}{{{least_signs},}}"
    found = matches(whole, candidate, 0, least_signs, whole.rlike(candidate))

    def random(m: Column) -> Column:
        sums = F.transform(F.array(models.llr(m["s"])), lambda r: (r >= F.lit(least_ratio) * (F.char_length(m["s"]) - 1)) & (r >= least_sum))
        return F.element_at(sums, 1)

    free = F.filter(found, lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & random(m))
    markov = tagged(free, len(RULES), "markov")
    return based.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct("base", markov.alias("markov")))))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, **settings) -> DataFrame:
    """Trains on ``samples`` (default: ``labelled_samples(docs)``) and scans."""
    return scan(docs, train(materialize(samples if samples is not None else labelled_samples(docs), "secret-samples")), **settings)
