"""A Merkle manifest of a dataset: levels of digests are built bottom up, inclusion proofs are pushed top down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .importance import CRC, crc_sql
from .numbering import numbered

#: A node's way to the root, its own end first: at each level the hex digests of its run ahead of it and behind it.
PATH = "array<struct<ahead:string,behind:string>>"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """A field as a leaf hashes it: `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row's fields; with text, as if that were its text."""
    fields = [F.col(c) for c in FIELDS[:-1]] + [F.col(FIELDS[-1]) if text is None else text]
    return F.sha2(F.concat(*map(framed, fields)), 256)


def levels(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """The levels above nodes (grp, number, of, digest), lowest first, each (grp, number, of, digest, kids).

    Runs of `fan` consecutive nodes of a group become their hash, kids are a run's digests in order, and of says how many
    nodes the group has on the level. A group takes part as long as it has several nodes. Every level is written.
    """
    most = nodes.agg(F.max("of")).first()[0] or 0
    tiers, below = [], nodes
    while most > 1:
        up = F.floor(F.col("number") / fan).cast("long").alias("number")
        runs = below.where("of > 1").groupBy("grp", up).agg(F.first("of").alias("of"), F.array_sort(F.collect_list(F.struct("number", "digest")))["digest"].alias("kids"))
        above = F.ceil(F.col("of") / fan).cast("long").alias("of")
        below = stored(runs.select("grp", "number", above, F.sha2(F.array_join("kids", ""), 256).alias("digest"), "kids"), "level")
        tiers.append(below)
        most = -(-most // fan)
    return tiers


def pushed(children: DataFrame, parents: DataFrame, fan: int) -> DataFrame:
    """children with what their parents know: root, subroot, and the parent's path behind the child's own siblings."""
    above = parents.select("grp", F.col("number").alias("_up"), F.col("kids").alias("_run"), F.col("path").alias("_rest"), "subroot", "root")
    at = F.pmod(F.col("number"), F.lit(fan)).cast("int")
    ahead, behind = F.array_join(F.slice("_run", F.lit(1), at), ""), F.array_join(F.slice("_run", at + 2, F.lit(fan)), "")
    met = children.withColumn("_up", F.floor(F.col("number") / fan).cast("long")).join(above, ["grp", "_up"])
    return met.withColumn("path", F.concat(F.array(F.struct(ahead.alias("ahead"), behind.alias("behind"))).cast(PATH), "_rest")).drop("_up", "_run", "_rest")


def proven(tiers: list[DataFrame], onward: DataFrame | None, fan: int) -> DataFrame:
    """The nodes of the lowest tier with path, subroot (the top of their group) and root.

    onward (grp, path, root) says how each group's top goes on; without it the top is the root. Each tier's nodes take
    over their parents' path, so a proof is gathered from no more than the tier above. Joins are on a run, `fan` rows to a
    key, however large a group is.
    """
    ways = None
    for k in reversed(range(len(tiers))):
        here = tiers[k].where("of = 1").withColumn("subroot", F.col("digest"))
        here = here.withColumn("path", F.array().cast(PATH)).withColumn("root", F.col("digest")) if onward is None else here.join(onward, "grp")
        if ways is not None:
            here = here.unionByName(pushed(tiers[k].where("of > 1"), ways, fan))
        ways = stored(here, "ways") if k else here
    return ways


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and the siblings of a path give."""
    return F.aggregate(path, digest, lambda below, run: F.sha2(F.concat(run["ahead"], below, run["behind"]), 256))


def manifest(docs: DataFrame, fan: int = 16, other: Column | None = None) -> DataFrame:
    """(doc_id, leaf, other, path, subroot, root) for every row of docs.

    A leaf hashes its row's fields. Leaves ascend by doc_id within a source; every `fan` consecutive nodes become one until
    one is left, the source's subroot; subroots, by source, go on likewise to the root. path holds the siblings of every level,
    with which `folded` recomputes the root. other is a second digest of the row to carry along.

    Nulls are fields of their own kind (`-`): a null source is a group, the first, and null doc_ids come first in theirs.
    Rows that repeat a doc_id are leaves each, ordered by their digest. An empty text differs from a null one. An empty
    table gives an empty result. Further columns are ignored.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # "-" comes first, the rest keeps its byte order
    other = F.lit(None).cast("string") if other is None else other
    leaves = stored(docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), other.alias("other")), "leaves")
    placed = stored(numbered(leaves, "grp", [F.asc_nulls_first("doc_id"), F.asc("digest")]), "placed")
    tiers = [placed, *levels(placed, fan)]
    tops = [t.where("of = 1").select(F.lit("").alias("grp"), F.col("grp").alias("source"), "digest") for t in tiers]
    subroots = stored(numbered(reduce(DataFrame.unionByName, tops), "grp", [F.asc("source")]), "subroots")
    above = proven([subroots, *levels(subroots, fan)], None, fan)
    onward = stored(above.select(F.col("source").alias("grp"), "path", "root"), "onward")
    return proven(tiers, onward, fan).select("doc_id", F.col("digest").alias("leaf"), "other", "path", "subroot", "root")


def manifest_digests(docs: DataFrame, fan: int = 16, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    proof_sha256 hashes the proof's siblings from the leaf's level up. Where `every` divides the CRC-32 of the doc_id, the row
    is tampered with after the manifest was made: its text's A-Z are lower-cased, and folded_root starts from the leaf that
    gives. Null texts and rows without a doc_id stay as they are.
    """
    struck = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0
    made = manifest(docs, fan, F.when(struck, leaf_digest(F.translate("text", UPPER, LOWER))))
    siblings = F.array_join(F.transform("path", lambda run: F.concat(run["ahead"], run["behind"])), "")
    out = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _frame(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _climb(name: str, depth: int, fan: int = 16) -> str:
    """SQL for the levels over {name}0 (grp, number, digest): {name}k, and {name}sk with the digests ahead and behind in a node's run."""
    parts = []
    for k in range(depth + 1):
        if k:
            parts.append(f"{name}{k} AS (SELECT grp, CASE WHEN n > 1 THEN number // {fan} ELSE number END AS number, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY number)) ELSE any_value(digest) END AS digest FROM {name}s{k - 1} GROUP BY 1, 2)")
        w = f"(PARTITION BY grp, number // {fan} ORDER BY number ROWS BETWEEN"
        parts.append(f"""{name}s{k} AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, coalesce(string_agg(digest, '') OVER {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS ahead,
  coalesce(string_agg(digest, '') OVER {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind FROM {name}{k})""")
    return ",\n ".join(parts)


def _fold(start: str, name: str, key: str, depth: int, fan: int = 16) -> str:
    """SQL that leads the rows of {start}0 (grp, number, proof, acc) up those levels."""
    parts = []
    for k in range(depth):
        parts.append(f"""{start}{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN f.number // {fan} ELSE f.number END AS number, CASE WHEN s.n > 1 THEN proof || ahead || behind ELSE proof END AS proof,
  CASE WHEN s.n > 1 THEN sha256(ahead || acc || behind) ELSE acc END AS acc) FROM {start}{k} f JOIN {name}s{k} s ON s.grp = f.{key} AND s.number = f.number)""")
    return ",\n ".join(parts)


def oracle_sql(depth: int = 5, sources: int = 3) -> str:
    """The manifest as SQL, for up to 16 ** depth leaves a source and 16 ** sources sources."""
    head, low = [_frame(c) for c in FIELDS[:-1]], f"translate(text, '{UPPER}', '{LOWER}')"
    plain, struck = " || ".join([*head, _frame("text")]), " || ".join([*head, _frame(low)])
    crc = crc_sql("encode(doc_id::VARCHAR)")
    return f"""
WITH {CRC},
 d AS (SELECT doc_id, coalesce('=' || source, '-') AS grp, sha256({plain}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({struck}) END AS struck FROM documents, crc_table),
 leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS number FROM d),
 a0 AS (SELECT grp, number, leaf AS digest FROM leaves),
 {_climb("a", depth)},
 b0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS number, digest, grp AS source FROM a{depth}),
 {_climb("b", sources)},
 f0 AS (SELECT doc_id, leaf, grp, number, '' AS proof, coalesce(struck, leaf) AS acc FROM leaves),
 {_fold("f", "a", "grp", depth)},
 g0 AS (SELECT f.doc_id, f.leaf, b.digest AS subroot, '' AS grp, b.number, proof, acc FROM f{depth} f JOIN b0 b ON b.source = f.grp),
 {_fold("g", "b", "grp", sources)}
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.digest AS verified FROM g{sources} JOIN b{sources} r ON true
"""


ORACLE_SQL = oracle_sql()
