"""Personal data by weak supervision, with DataFrame operations only.

Base patterns give certain spans. Looser patterns give further candidates, and regex, gazetteer and context labelers vote
on every candidate. Expectation-maximisation over the table of vote patterns estimates how reliable each labeler is; a
logistic span classifier is then trained on the posterior labels, and its score decides on the further candidates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .spans import apart, joined, matches

KINDS = ("email", "ip", "card", "phone")
# The base patterns. The look-behinds and \G only spare vain starts inside a run, and possessive quantifiers
# vain steps back; what matches is the same. Card numbers are read where JOIN stands for one space or hyphen between digits.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
JOIN, OTHER = "\x01", "\x02"
CARD = f"[0-9][0-9{JOIN}]++"
# Looser patterns for further candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?i:dot)[\])]\x20?|\.)[A-Za-z]++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?[\[(](?:\.|(?i:dot))[\])]\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9./_])[0-9]{4}+(?:[./_\xA0][0-9]{4,6}+){2}(?:[./_\xA0][0-9]{3,5}+)?(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?0?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
LOOSE_GATE = {
    "email": r"[\[(](?i:at)[\])]",
    "ip": r"[0-9]\x20?[\[(](?:\.|(?i:dot))[\])]",
    "card": r"[0-9]{4}[./_\xA0][0-9]{4}",
    "phone": r"[0-9]\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}",
}
# Gazetteers (top-level domains, issuer prefixes, calling codes) and words of the context, by kind.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|example)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[0-1][0-9]|22[0-3])(?![0-9])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+|00)?(?:1|33|34|39|44|49|41|43|351|32|31)?[\x20(.-]*[0-9]{2,4}",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|courriel|correo|schreib)",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|login|client|visitor)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta|konto)",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|anruf|t[eé]l[eé]phone|tel[eé]fono|llam)",
}
REACH = 40
LABELERS = ("shape", "check", "gazetteer", "context", "alone")
#: What the span classifier sees besides the votes, each 1 or -1: a word of any kind's context close by, an end of a
#: sentence or line behind the span, and a span of 12 characters or more.
FEATURES = ("other context", "ends", "long")
CANDIDATE = "array<struct<s:int,e:int,m:string,g:string>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits(m))
    values = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(m: Column) -> Column:
    """Every dotted part is at most 255, leading zeros aside."""
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(bare, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


def valid(kind: str, m: Column) -> Column:
    n = F.char_length(digits(m))
    return {
        "email": F.lit(True),
        "ip": small_parts(m),
        "card": n.between(12, 19) & luhn(m),
        "phone": n.between(9, 15),
    }[kind]


def checked(kind: str, m: Column) -> Column:
    """The labeler that tests what a pattern can't: 1, 0 or -1."""
    n = F.char_length(digits(m))
    if kind == "card":
        return F.when(luhn(m) & n.between(13, 16), 1).otherwise(-1)
    if kind == "phone":
        return F.when(n.between(10, 13), 1).when(n.between(9, 15), 0).otherwise(-1)
    if kind == "ip":
        return F.when(small_parts(F.regexp_replace(m, "[^0-9]+", ".")), 1).otherwise(-1)
    return F.when(F.char_length(m) <= 254, 1).otherwise(-1)


def base_spans(t: Column) -> dict[str, Column]:
    read = F.translate(t, JOIN, OTHER)
    read = F.regexp_replace(read, "(?<=[0-9])[ -](?=[0-9])", JOIN)
    found = {
        "email": matches(t, EMAIL, 0, t.contains("@")),
        "ip": matches(t, IP, 0, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        "card": F.when(t.rlike("[0-9](?:[ -]?[0-9]){11}"), matches(read, CARD)).otherwise(F.array().cast(CANDIDATE)),
        "phone": matches(t, PHONE, 0, t.rlike(r"\+[0-9]")),
    }

    def passing(kind: str):
        return lambda x: valid(kind, x["m"])

    return {k: F.filter(v, passing(k)) for k, v in found.items()}


def voted(t: Column, found: Column, kind: str, base: bool) -> Column:
    """found with its labelers' votes, each 1, 0 or -1, and the classifier's further features."""
    others = "|".join(f"(?:{v})" for k, v in CONTEXT.items() if k != kind)

    def vote(x: Column) -> Column:
        before = F.substring(t, F.greatest(x["s"] + 1 - REACH, F.lit(1)), x["s"] - F.greatest(x["s"] - REACH, F.lit(0)))
        after = F.substring(t, x["e"] + 1, F.lit(REACH))
        votes = (
            F.lit(1 if base else 0),
            checked(kind, x["m"]),
            F.when(x["m"].rlike(GAZETTEER[kind]), 1).otherwise(-1),
            F.when(F.concat(before, F.lit(" \n "), after).rlike(CONTEXT[kind]), 1).otherwise(0),
            F.when(F.concat(F.substring(before, -6, 6), F.lit(" "), F.substring(after, 1, 6)).rlike("[0-9]"), -1).otherwise(1),
        )
        features = (
            F.when(F.concat(before, F.lit(" \n "), after).rlike(others), 1).otherwise(-1),
            F.when(after.rlike(r"^[\x20)\]]*(?:[.!?;\n]|$)"), 1).otherwise(-1),
            F.when(F.char_length(x["m"]) >= 12, 1).otherwise(-1),
        )
        ints = [F.array(*[v.cast("int") for v in some]) for some in (votes, features)]
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), ints[0].alias("votes"), ints[1].alias("features"))

    return F.transform(found, vote)


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """(prior, for each labeler vote -> (P(vote | personal), P(vote | not)), posterior of each pattern), by expectation-maximisation.

    patterns: (votes, how many candidates have them). Starts from the share of positive votes; counts are smoothed by one.
    """
    n = len(patterns[0][0])
    post = [min(0.95, max(0.05, 0.5 + sum(v) / (2 * n))) for v, _ in patterns]
    prior, table = 0.5, []
    for _ in range(rounds):
        yes = sum(p * c for p, (_, c) in zip(post, patterns))
        total = sum(c for _, c in patterns)
        prior = (yes + 1) / (total + 2)
        table = []
        for j in range(n):
            counts = {v: [1.5 if v > 0 else 1.0, 1.5 if v < 0 else 1.0] for v in (-1, 0, 1)}
            for p, (votes, c) in zip(post, patterns):
                counts[votes[j]][0] += p * c
                counts[votes[j]][1] += (1 - p) * c
            sums = [sum(x[k] for x in counts.values()) for k in (0, 1)]
            table.append({v: (x[0] / sums[0], x[1] / sums[1]) for v, x in counts.items()})
        post = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][v][0] / table[j][v][1]) for j, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return prior, table, post


def weights_of(counts: dict[tuple[tuple[int, ...], tuple[int, ...]], float]) -> list[float]:
    """The classifier of one kind from (votes, features) -> how many candidates have them: a posterior for each pattern of
    votes, and on these a model over votes and features."""
    votes: dict[tuple[int, ...], float] = {}
    for (v, _), n in counts.items():
        votes[v] = votes.get(v, 0.0) + n
    patterns = sorted(votes.items())
    post = dict(zip((v for v, _ in patterns), reliabilities(patterns)[2]))
    rows = sorted(counts.items())
    return train([((*v, *f), n) for (v, f), n in rows], [post[v] for (v, _), _ in rows])


def train(patterns: list[tuple[tuple[int, ...], float]], labels: list[float], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic model, the bias last, on soft labels weighted by their counts; plain gradient descent."""
    n, total = len(patterns[0][0]), sum(c for _, c in patterns)
    w = [0.0] * (n + 1)
    for _ in range(steps):
        grad = [decay * x for x in w[:-1]] + [0.0]
        for (votes, c), y in zip(patterns, labels):
            x = (*votes, 1)
            z = sum(a * b for a, b in zip(w, x))
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * c / total
            for j, v in enumerate(x):
                grad[j] += e * v
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) for every row.

    Counts and base_sha256 are of the base spans, which always stay; spans has those and the further candidates that
    overlap none of them and score `least` or more. Null text is empty and has no spans. Repeated rows stay repeated;
    a kind without candidates trains nothing and adds nothing.

    The texts are read once: spans and votes go to a stored table, of which only the counts of vote patterns (at most
    4 x 3^5 x 2^3 rows, however large the input) come to the driver, where the two small models are fitted.
    """
    t = F.col("t")
    base = docs.select("doc_id", text_or_empty().alias("t"))
    spans = base_spans(t)
    one = base.select("doc_id", "t", *[v.alias(k) for k, v in spans.items()], *[matches(t, LOOSE[k], 0, t.rlike(LOOSE_GATE[k])).alias(f"loose_{k}") for k in LOOSE])
    all_base = [F.col(k) for k in KINDS]
    parts = [voted(t, F.col(k), k, True) for k in KINDS]
    parts += [voted(t, apart(F.col(f"loose_{k}"), *all_base, *[F.col(f"loose_{x}") for x in list(LOOSE)[:i]]), k, False) for i, k in enumerate(LOOSE)]
    found = stored(one.select("doc_id", F.concat(*parts).alias("spans")), "candidates")

    each = found.select(F.explode("spans").alias("x")).groupBy("x.kind", "x.votes", "x.features").agg(F.count("*").alias("n"))
    counts: dict[str, dict] = {}
    for r in each.collect():
        counts.setdefault(r.kind, {})[tuple(r.votes), tuple(r.features)] = float(r.n)
    weights = {k: weights_of(c) for k, c in sorted(counts.items())}

    def score(x: Column) -> Column:
        out = F.lit(0.0)
        for k, w in weights.items():
            seen = [F.get(x["votes"], F.lit(j)) for j in range(len(LABELERS))] + [F.get(x["features"], F.lit(j)) for j in range(len(FEATURES))]
            z = reduce(lambda a, b: a + b, [F.lit(w[-1]), *[F.lit(c) * v for c, v in zip(w, seen)]])
            out = F.when(x["kind"] == k, 1 / (1 + F.exp(-z))).otherwise(out)
        return out

    rank = F.create_map(*[y for i, k in enumerate(KINDS) for y in (F.lit(k), F.lit(i))])

    def ordered(x: Column) -> Column:
        return F.transform(x, lambda y: F.struct(y["s"].alias("s"), rank[y["kind"]].alias("rank"), y["e"].alias("e"), y["kind"].alias("kind")))

    def base_of(kind: str):
        return lambda x: x["base"] & (x["kind"] == kind)

    sure = F.filter("spans", lambda x: x["base"])
    added = F.filter("spans", lambda x: ~x["base"] & (score(x) >= least))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", base_of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.size(added).cast("long").alias("n_added"),
        F.sha2(joined(ordered(sure)), 256).alias("base_sha256"),
        joined(ordered(sure), ordered(added)).alias("spans"),
    )
