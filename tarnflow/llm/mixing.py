"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .numbering import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the mix: weights of the sources in their order, repeating; how often a word is taken at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words in a block, and about how many a shard has.
BLOCK, SHARD = 16, 65_536


def hashed(*keys: Column) -> Column:
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))


def number_of(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def filled(sources: DataFrame, most: int) -> DataFrame:
    """sources (grp, source_size, weight) with target: shares of the whole by weight, none above `most` times its size.

    The excess of capped sources goes to the others by weight until none is above: a level per unit of weight rises until
    the capped sources stay the same. Each round sums the table once; rounds are as many as new sources get capped in turn.
    """
    cap = most * F.col("source_size")
    total, level, capped = 0, 0.0, -1
    while True:
        over = F.lit(capped >= 0) & (F.lit(level) * F.col("weight") > cap)
        r = sources.agg(F.sum("source_size").alias("t"), F.sum(F.when(over, cap).otherwise(0)).alias("c"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("w"), F.count_if(over).alias("n")).first()
        if r.n == capped or not r.w:
            break
        total, capped = r.t, r.n
        level = (total - r.c) / r.w
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") > cap, cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def apportioned(claims: DataFrame, key: str) -> DataFrame:
    """(grp, key, quota) of claims (grp, key, votes, seats): each group's seats go to the highest quotients votes / (2k + 1).

    Ties go to the smaller key; without votes there are no seats. The number of seats of a claim lies between its share of
    n / 2 + 1 seats fewer than there are, and of as many more, rounded (n: the group's claims). All below is certain; only
    quotients between, some two or four to a claim, are ranked.
    """
    sums = claims.groupBy("grp").agg(F.sum("votes").alias("_v"), F.count_if(F.col("votes") > 0).alias("_n"))
    slack = F.col("_n") / 2 + 1

    def rounded(seats: Column) -> Column:
        return F.greatest(F.coalesce(F.floor(F.try_divide(F.col("votes") * seats, F.col("_v")) + 0.5).cast("long"), F.lit(0)), F.lit(0))

    bounds = claims.join(sums, "grp").select("grp", key, "votes", "seats", rounded(F.col("seats") - slack).alias("low"), rounded(F.col("seats") + slack).alias("high"))
    bounds = stored(bounds, "bounds")
    left = bounds.groupBy("grp").agg((F.first("seats") - F.sum("low")).alias("left"))
    quotients = bounds.where("high > low").select("grp", key, "votes", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("k"))
    ranked = numbered(quotients.withColumn("quotient", F.col("votes") / (2 * F.col("k") + 1)), "grp", [F.desc("quotient"), F.asc(key)])
    won = ranked.join(left, "grp").where("number < left").groupBy("grp", key).agg(F.count("*").alias("won"))
    return bounds.join(won, ["grp", key], "left").select("grp", key, (F.col("low") + F.coalesce("won", F.lit(0))).alias("quota"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs.

    size counts the words of the text (null: none). Sources, by code point and null last, weigh `weights` in turn and share
    the size of the whole; a target stops at `most` times its source's size. Blocks of `block` words are dealt to sources, and
    within a source to its shards, by the highest quotients of their targets and sizes. A shard holds whole documents in
    the order of a seeded hash; its quota takes all its blocks so many times and the rest from a seeded block on, round the
    end. taken is how many words of the document that takes, `most` times its size at most; it depends on seed, doc_id and
    sizes only, so reruns agree.

    Empty texts have size 0 and are not taken; an empty table gives an empty result. Rows that repeat a doc_id count each.
    A source of any size is spread over shards; the number of sources is not bounded either, as nothing is gathered by
    source but its sums. Other columns are ignored.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(">"))  # ">" follows "=": null is last
    sized = stored(docs.select("doc_id", F.col("source").alias("source"), grp.alias("grp"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")), "sizes")
    sums = stored(sized.groupBy("grp").agg(F.sum("size").alias("source_size")), "sources")
    order = numbered(sums.withColumn("_all", F.lit(0)), "_all", [F.asc("grp")])
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))).cast("int"))
    sources = stored(filled(stored(order.select("grp", "source_size", weight.cast("long").alias("weight")), "weights"), most), "targets")

    words = sources.agg(F.sum("source_size")).first()[0] or 0
    claims = sources.select(F.lit(0).alias("grp"), F.col("grp").alias("source"), F.col("target").alias("votes"), F.lit((words + block // 2) // block).alias("seats"))
    quotas = stored(apportioned(claims, "source").select(F.col("source").alias("grp"), F.col("quota").alias("seats")), "quotas")

    mark = hashed(F.lit(seed), F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    dealt = sized.join(sources.select("grp", "source_size", "target"), "grp").withColumn("mark", mark).withColumn("shard", F.pmod(number_of(F.substring("mark", 1, 8)), shards))
    filled_ = stored(dealt.groupBy("grp", "shard").agg(F.sum("size").cast("long").alias("words")), "shards")
    held = filled_.join(quotas, "grp").select("grp", "shard", F.col("words").cast("double").alias("votes"), "seats")
    blocks, quota = F.ceil(F.col("words") / block), F.least("quota", most * F.col("blocks"))
    taken = apportioned(held, "shard").join(filled_, ["grp", "shard"]).where("words > 0").withColumn("blocks", blocks).withColumn("quota", quota)
    first = F.pmod(number_of(F.substring(hashed(F.lit(seed), F.lit("shard"), F.col("grp"), F.col("shard")), 1, 8)), F.col("blocks"))
    plan = stored(taken.select("grp", "shard", "words", "blocks", F.floor(F.col("quota") / F.col("blocks")).alias("rounds"), F.pmod("quota", "blocks").alias("more"), first.alias("first")), "plan")

    place = F.expr("sum(size) OVER (PARTITION BY grp, shard ORDER BY substr(mark, 9), doc_id, size ROWS UNBOUNDED PRECEDING)")
    placed = dealt.withColumn("b", place).withColumn("a", F.col("b") - F.col("size")).join(plan, ["grp", "shard"], "left")

    def within(low: Column, high: Column) -> Column:
        return F.greatest(F.least(F.col("b"), high) - F.greatest(F.col("a"), low), F.lit(0))

    end = F.col("first") + F.col("more")
    extra = within(F.col("first") * block, F.least(end * block, F.col("words"))) + within(F.lit(0), (end - F.col("blocks")) * block)
    return placed.select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.col("rounds") * F.col("size") + extra, F.lit(0)).cast("long").alias("taken"))


def _apportioned(name: str, claims: str, key: str) -> str:
    def rounded(sign: str) -> str:
        return f"greatest(coalesce(CAST(floor(votes * (seats {sign} (v.n / 2 + 1)) / nullif(v.v, 0) + 0.5) AS BIGINT), 0), 0)"

    return f"""{name}_v AS (SELECT grp, sum(votes) AS v, count(*) FILTER (votes > 0) AS n FROM {claims} GROUP BY 1),
 {name}_b AS (SELECT c.*, {rounded("-")} AS low, {rounded("+")} AS high FROM {claims} c JOIN {name}_v v USING (grp)),
 {name}_q AS (SELECT grp, {key}, votes, unnest(range(low, high)) AS k FROM {name}_b),
 {name}_r AS (SELECT grp, {key}, row_number() OVER (PARTITION BY grp ORDER BY votes / (2 * k + 1) DESC, {key}) AS r FROM {name}_q),
 {name}_w AS (SELECT grp, {key}, count(*) AS won FROM {name}_r JOIN (SELECT grp, any_value(seats) - sum(low) AS remain FROM {name}_b GROUP BY 1) USING (grp) WHERE r <= remain GROUP BY 1, 2),
 {name} AS (SELECT b.grp, b.{key}, low + coalesce(won, 0) AS quota FROM {name}_b b LEFT JOIN {name}_w USING (grp, {key}))"""


def _number(digits: str) -> str:
    return f"('0x' || substr({digits}, 1, 8))::BIGINT"


ORACLE_SQL = rf"""
WITH sized AS (SELECT doc_id, coalesce('=' || source, '>') AS grp, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('7:doc:' || doc_id) AS mark FROM documents),
 sums AS (SELECT grp, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
 weighed AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY grp) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM sums),
 risen AS (SELECT *, ((SELECT sum(source_size) FROM sums) - {MOST} * coalesce(sum(source_size) OVER w, 0))::DOUBLE / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS level,
   row_number() OVER (ORDER BY source_size / weight, grp) AS turn FROM weighed WINDOW w AS (ORDER BY source_size / weight, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 water AS (SELECT arg_min(level, turn) AS level FROM risen WHERE level * weight <= {MOST} * source_size),
 sources AS (SELECT grp, source_size, CASE WHEN level * weight > {MOST} * source_size THEN {MOST} * source_size::DOUBLE ELSE level * weight END AS target FROM weighed, water),
 claims AS (SELECT 0 AS grp, grp AS source, target AS votes, ((SELECT sum(source_size) FROM sums) + {BLOCK // 2}) // {BLOCK} AS seats FROM sources),
 {_apportioned("quotas", "claims", "source")},
 dealt AS (SELECT s.*, source_size, target, {_number("mark")} % greatest(CAST(ceil(source_size / {SHARD}) AS BIGINT), 1) AS shard FROM sized s JOIN sources USING (grp)),
 shards AS (SELECT grp, shard, sum(size)::BIGINT AS words FROM dealt GROUP BY 1, 2),
 held AS (SELECT s.grp, shard, words::DOUBLE AS votes, quota AS seats FROM shards s JOIN quotas q ON q.source = s.grp),
 {_apportioned("parts", "held", "shard")},
 counted AS (SELECT s.*, CAST(ceil(words / {BLOCK}) AS BIGINT) AS blocks, quota FROM shards s JOIN parts USING (grp, shard) WHERE words > 0),
 plan AS (SELECT grp, shard, words, blocks, least(quota, {MOST} * blocks) // blocks AS rounds, least(quota, {MOST} * blocks) % blocks AS more, {_number("md5('7:shard:' || grp || ':' || shard)")} % blocks AS "first" FROM counted),
 placed AS (SELECT d.*, sum(size) OVER (PARTITION BY grp, shard ORDER BY substr(mark, 9), doc_id, size ROWS UNBOUNDED PRECEDING) AS b FROM dealt d)
SELECT doc_id, size, source_size, target, CAST(coalesce(rounds * size + greatest(least(b, least(("first" + more) * {BLOCK}, words)) - greatest(b - size, "first" * {BLOCK}), 0) + greatest(least(b, ("first" + more - blocks) * {BLOCK}) - greatest(b - size, 0), 0), 0) AS BIGINT) AS taken
FROM placed LEFT JOIN plan USING (grp, shard)
"""
