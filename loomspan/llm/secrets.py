"""Secret scan in DataFrame functions only.

Three base patterns (assignments, access key ids, long hex runs) give exact spans. Beside them every token of 20 or more
characters whose characters fit an encoding (hex, base32, base36, base64; digits and letters must both occur) is put to
tests. A battery (chi-squared uniformity over the alphabet, runs about the median, serial correlation of neighbours; their
squared deviates are summed) asks whether the token may be random in its encoding. The rate at which two of its characters
agree asks whether it may be ordinary text in that encoding, where agreement is as frequent as COMMON says: the p-value of
that null hypothesis is small where characters agree too seldom, and 1 where the battery finds the token not random.
Within each encoding and class of lengths, Benjamini-Hochberg over all tokens of the corpus decides which are reported as
`random` (unless they meet a base span), so that at most a twentieth of a class's reports are ordinary text in expectation;
a short token with little evidence needs company to be reported. P-values are counted in bins of a fixed number, so what
reaches the driver is one threshold for each of 16 classes.

Edge cases: a null or empty text has no spans and the digest of the empty string; null and repeated ids are rows like any
other; an empty table gives an empty result; extra columns are not read. The time for a text grows with its length and with
k log k for k matches; a token may have any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import saved
from .common import table, texts

#: Base patterns (fixed by the contract), and what a text must have for a pattern to be tried.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of that length: shorter ones fail wherever they start
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Encodings by name: pattern (after - and _ became + and /), alphabet. The first that fits is inferred.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-zA-Z])([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
KINDS = ("assign", "access", "hex", "random")
#: How often two characters of ordinary text agree, and three, by encoding: decimal digits among hex; written language in
#: one case; somewhat less often where both cases mix.
COMMON = ((0.1, 0.01), (0.065, 0.0053), (0.065, 0.0053), (0.058, 0.0045))
#: The battery's limit, as -log10 of a p-value; the false-discovery rate; bins of -log10 of a p-value, so many to one.
NOT_RANDOM, RATE, BINS, FINE = 3.0, 0.05, 400, 20.0
#: Running sums reach over 2^24 matches in a text.
DOUBLINGS = 24
SPAN = "array<struct<start: int, kind_no: int, end: int, kind: string>>"


def _let(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x worked out once."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def _running(x: Column, step: int = 1) -> Column:
    """Running sums of an array, by doubling: short arrays stop early."""
    if step == 1 << DOUBLINGS:
        return x
    more = F.transform(x, lambda v, i: v + F.coalesce(F.get(x, i - step), F.lit(0)))
    return F.when(F.size(x) <= step, x).otherwise(_let(more, lambda y: _running(y, 2 * step)))


def _located(text: Column, pattern: str, hint: Column, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the matches, in code points. Their places follow from the lengths between them."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    ends = _let(F.struct(gaps.alias("gaps"), sizes.alias("sizes")), lambda x: _let(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["sizes"])), x["sizes"], lambda a, b: a + b), lambda y: _running(y)))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.arrays_zip(ends.alias("end"), sizes.alias("size"), values.alias("value"))
    spans = F.transform(found, lambda x: F.struct((x["end"] - x["size"]).alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return F.flatten(F.filter(F.array(F.when(hint, spans)), lambda x: x.isNotNull()))


def _spans(found: Column, kind: int, least: int) -> Column:
    long_enough = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.transform(long_enough, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind_no"), x["end"].alias("end"), F.lit(KINDS[kind]).alias("kind"))).cast(SPAN)


def _battery(found: Column) -> Column:
    """array<struct<start, end, class, bin>>: class of encoding and length, and the bin of -log10 of the p-value."""
    def inferred(x: Column) -> Column:
        token = F.translate(x["value"], "-_", "+/")
        which = F.lit(None).cast("int")
        for i in reversed(range(len(ENCODINGS))):
            which = F.when(token.rlike(ENCODINGS[i][1]), i).otherwise(which)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), token.alias("token"), which.alias("which"))

    def valued(x: Column) -> Column:
        alphabet = F.element_at(F.array(*(F.lit(a) for *_, a in ENCODINGS)), x["which"] + 1)
        token = F.when((x["which"] == 0) | (x["which"] == 2), F.lower(x["token"])).otherwise(x["token"])
        values = F.transform(F.split(token, "(?!^)"), lambda c: F.position(c, alphabet) - 1)
        times = F.transform(F.split(alphabet, "(?!^)"), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["which"].alias("which"), F.length(alphabet).cast("double").alias("m"), F.length(token).cast("double").alias("n"), values.alias("v"), times.alias("times"))

    def tested(x: Column) -> Column:
        v, n, m = x["v"], x["n"], x["m"]
        squares = F.aggregate(x["times"], F.lit(0.0), lambda a, c: a + c * c)
        chi, df = squares * m / n - n, m - 1
        uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        a, b = F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1)
        turns = F.aggregate(F.zip_with(a, b, lambda p, q: F.when((p * 2 >= m) != (q * 2 >= m), 1.0).otherwise(0.0)), F.lit(0.0), lambda s, y: s + y)
        runs = (turns - (n - 1) / 2) / (F.sqrt(n - 1) / 2)
        mean = (m - 1) / 2
        products = F.aggregate(F.zip_with(a, b, lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda s, y: s + y)
        serial = products / ((m * m - 1) / 12) / F.sqrt(n - 1)
        two, three = (F.element_at(F.array(*(F.lit(c[i]) for c in COMMON)), x["which"] + 1) for i in range(2))
        agree = (squares - n) / (n * (n - 1))
        spread = F.sqrt((2 * two * (1 - two) + 4 * (n - 2) * F.greatest(three - two * two, F.lit(0.0))) / (n * (n - 1)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["which"].alias("which"), n.alias("n"),
                        (F.pow(F.greatest(uniform, F.lit(0.0)), F.lit(2.0)) + runs * runs + serial * serial).alias("t"), ((two - agree) / spread).alias("seldom"))

    def upper_tail(z: Column) -> Column:
        """-log10 of the chance that a normal deviate is above z (0 or more)."""
        return (0.717 * z + 0.416 * z * z) / 2.302585 + 0.30103

    def binned(x: Column) -> Column:
        departs = (F.pow(x["t"] / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / (2 / 27) ** 0.5
        not_random = upper_tail(F.greatest(departs, F.lit(0.0))) > NOT_RANDOM
        minus_log = F.when(not_random | (x["seldom"] <= 0), F.lit(0.0)).otherwise(upper_tail(x["seldom"]))
        length_class = F.when(x["n"] < 28, 0).when(x["n"] < 40, 1).when(x["n"] < 64, 2).otherwise(3)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["which"] * 4 + length_class).alias("class"), F.least(F.floor(FINE * minus_log), F.lit(BINS)).cast("int").alias("bin"))

    known = F.filter(F.transform(found, inferred), lambda x: x["which"].isNotNull())
    return F.transform(F.transform(F.transform(known, valued), tested), binned)


def _thresholds(tested: DataFrame) -> dict[int, int]:
    """By class: tokens in this bin or above are reported (Benjamini-Hochberg; a bin counts with its greatest p-value)."""
    bins = tested.select(F.explode("tested").alias("x")).groupBy("x.class", "x.bin").count()
    above = Window.partitionBy("class").orderBy(F.desc("bin"))
    ranked = bins.withColumn("k", F.sum("count").over(above)).withColumn("m", F.sum("count").over(Window.partitionBy("class")))
    rejected = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / FINE) <= RATE * F.col("k") / F.col("m"))
    return {r["class"]: r["bin"] for r in rejected.groupBy("class").agg(F.min("bin").alias("bin")).collect()}  # 16 rows at most


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind_no"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and found (the spans as structs)."""
    text = F.col("text")
    first = texts(docs).select(
        "doc_id",
        F.array_sort(F.concat(
            _spans(_located(text, ASSIGN, text.rlike(ASSIGN_HINT), 2), 0, 6),
            _spans(_located(text, ACCESS, text.contains("AKIA")), 1, 20),
            _spans(_located(text, HEX, text.rlike(HEX)), 2, 24))).alias("base"),
        _battery(_located(text, TOKEN, text.rlike(TOKEN))).alias("tested"))
    first = saved(first, "secrets")
    limits = _thresholds(first)
    bounds = F.array(*(F.lit(limits.get(i, BINS + 1)) for i in range(4 * len(ENCODINGS))))
    random = F.filter("tested", lambda x: (x["bin"] >= F.element_at(bounds, x["class"] + 1)) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    random = F.transform(random, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind_no"), x["end"].alias("end"), F.lit(KINDS[3]).alias("kind"))).cast(SPAN)
    every = F.array_sort(F.concat("base", random))
    return first.select(
        "doc_id", *(_count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), every.alias("found"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")
