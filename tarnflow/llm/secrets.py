"""Secret scan with SQL functions only: fixed patterns, and the entropy of sliding windows over candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .spans import apart, joined, let, matches, placed

# The base patterns. Runs of hex and access keys carry their least length, since only a maximal run can match.
NAMES = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = "(" + NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}+"
HEX = "[0-9a-f]{16,}+"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}+"
#: Bits of entropy a window of WINDOW characters must reach, by the candidate's character class.
WINDOW = 20
LIMITS = {"hex": 2.9, "upper": 3.4, "mixed": 3.6}
# What is long and varied but no secret: identifiers, paths, words joined by signs, placeholders, alphabets.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    "|^[A-Za-z]*(?:[-_/+=][A-Za-z]*)*+$|^[0-9+/_=-]*$|^[A-Za-z]+[0-9]{1,4}$"
    "|(?i:example|sample|placeholder|changeme|xxxx|your_?|test_?key|abcdefgh|01234567|12345678)|(?i:^sha(?:1|256|512)-)"
    "|^(?:/?[a-z0-9_-]{1,15}/)++[a-z0-9_-]*$"
)


def candidate_class(m: Column) -> Column:
    return F.when(m.rlike("^[0-9a-fA-F]+$"), "hex").when(m.rlike("^[A-Z0-9]+$"), "upper").otherwise("mixed")


def xlogx(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)).cast("double"))).otherwise(0.0)


def window_entropy(m: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of the windows of an ASCII string of at least `window` characters.

    Walks the string once with the counts of the current window, held as the code points of a string of 128: what
    enters adds to its count, what leaves is taken off, and the sum of c*log2(c) follows from the two counts that change.
    """

    def count(counts: Column, code: Column) -> Column:
        return F.ascii(F.substring(counts, code + 1, F.lit(1)))

    def step(acc: Column, x: Column) -> Column:
        def moved(n: Column) -> Column:
            gained, lost = xlogx(n["new"] + 1) - xlogx(n["new"]), F.when(x["old"] >= 0, xlogx(n["old"]) - xlogx(n["old"] - 1)).otherwise(0.0)
            entered = F.overlay(acc["counts"], F.char(n["new"] + 1), x["new"] + 1, F.lit(1))
            counts = F.when(x["old"] >= 0, F.overlay(entered, F.char(n["old"] - 1), x["old"] + 1, F.lit(1))).otherwise(entered)
            total = acc["sum"] + gained - lost
            best = F.when(x["whole"], F.greatest(acc["best"], F.lit(math.log2(window)) - total / window)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

        now = F.struct(count(acc["counts"], x["new"]).alias("new"), F.when(x["old"] >= 0, count(acc["counts"], x["old"])).otherwise(0).alias("old"))
        same = F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"), acc["best"].alias("best"))
        return F.when(x["new"] == x["old"], same).otherwise(let(now, moved))

    def walk(codes: Column) -> Column:
        steps = F.transform(
            codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(codes, i - window)).otherwise(-1).alias("old"), (i >= window - 1).alias("whole"))
        )
        zero = F.struct(F.repeat(F.char(F.lit(0)), F.lit(128)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(steps, zero, step, lambda acc: acc["best"])

    return let(F.transform(F.split(m, ""), lambda c: F.ascii(c)), walk)


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for every row.

    Base spans are assignments to telling names, access keys and long hex runs; the method adds, as kind entropy,
    candidate strings of 20 characters or more, with letters and digits, of which some window's entropy reaches the
    limit of their class, that overlap no base span and no allowed form. Null text is empty and has no spans; empty texts
    have the digest of the empty string. Repeated rows stay repeated. One pass, no shuffle.
    """
    t = F.col("t")
    base = docs.select("doc_id", text_or_empty().alias("t"))
    assign = F.filter(matches(t, ASSIGN, 2, t.rlike(NAMES + "[\"' :=]")), lambda x: F.char_length(x["g"]) >= 12)
    access = matches(t, ACCESS, 0, t.contains("AKIA"))
    hexes = matches(t, HEX, 0, t.rlike(HEX))
    telling = "(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Za-z])"
    candidates = matches(t, CANDIDATE, 0, t.rlike("(?<![A-Za-z0-9+/_=-])" + telling + CANDIDATE))
    found = base.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), candidates.alias("candidates"))
    varied = F.filter(
        apart(F.col("candidates"), F.col("assign"), F.col("access"), F.col("hex")),
        lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~x["m"].rlike(ALLOWED) & (window_entropy(x["m"]) >= F.coalesce(*[F.when(candidate_class(x["m"]) == k, v) for k, v in LIMITS.items()])),
    )
    kinds = ("assign", "access", "hex")
    base_parts = [placed(F.col(k), k, i) for i, k in enumerate(kinds)]
    return found.withColumn("entropy", varied).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in (*kinds, "entropy")],
        F.sha2(joined(*base_parts), 256).alias("base_sha256"),
        joined(*base_parts, placed(F.col("entropy"), "entropy", 3)).alias("spans"),
    )
