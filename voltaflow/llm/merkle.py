"""Merkle dataset manifest by window-based levels (operator 12); DataFrame functions only.

Every row is a leaf. At each level, nodes are partitioned by group and parent index; the ordered full-frame
list of a parent's children gives both the parent's preimage and each child's siblings; one row of each
parent goes to the next level. Ten levels are climbed at a time: 1024 neighbouring nodes are placed together
by one shuffle, the windows of all ten levels keep that placing, and the row that is left holds the paths of
its 1024 nodes, which is a fixed bound. Its parents' paths are joined to that row, not to the leaves, so no
join has a key with more than one row a side.

Leaves are numbered within their group by ranges of (group, id, leaf) and counts of the rows before, so no
group is sorted in one task.

Defined results: rows without a language are a group of their own, the first; within a group, rows without
an id come first, rows of one id are ordered by their leaf, repeated rows are leaves of their own; rows
without an id are never tampered with; an empty table gives no rows; long texts count whole; only the five
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels climbed by one shuffle (its chunks have 2 ** SPAN nodes); of ids whose crc32 it divides, the leaf is tampered with.
SPAN, TAMPER = 10, 7
PATH = "array<struct<at:int,others:binary>>"


def leaf(**replaced: Column) -> Column:
    """Hex digest of a row: each field as its byte count and value, a dash where it is null."""
    parts = []
    for name in FIELDS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """The digests of an array, joined as bytes."""
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def leaves(docs: DataFrame) -> DataFrame:
    """grp (orders as the language does, null first), doc_id, digest, used (of the tampered row, else null)."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0
    changed = F.when(hit & F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    return docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf()).alias("digest"), F.unhex(changed).alias("used"))


def numbered(spark: SparkSession, scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with idx (place within grp by order, nulls first, from 0) and total (rows of grp)."""
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(n, "grp", *order).sortWithinPartitions("grp", *order)
    spread = scratch.write(spread.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    spans = spread.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    spans = spans.select("grp", "part", "first", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    return spread.join(spans, ["grp", "part"]).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "total")


def rise(nodes: DataFrame, span: int) -> DataFrame:
    """Climb span levels: grp, chunk (the node's place), total (nodes of grp), digest, below (array of own, path) of nodes (grp, idx, total, digest, own).

    A group of one node stays as it is.
    """
    below = F.array(F.struct("own", F.array().cast(PATH).alias("path")))
    at = nodes.select("grp", "total", F.shiftright("idx", span).alias("chunk"), "idx", "digest", below.alias("below")).repartition("grp", "chunk")
    for level in range(span):
        at = at.withColumn("parent", F.shiftright("idx", 1))
        run = Window.partitionBy("grp", "chunk", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = at.withColumn("kids", F.collect_list(F.struct("digest", "below")).over(run)).where("idx % 2 = 0")
        several, kids = F.col("total") > (1 << level), F.col("kids")

        def grown(kid: Column, i: Column) -> Column:
            others = joined(F.transform(F.filter(kids, lambda _, j: j != i), lambda k: k["digest"]))
            step = F.array(F.struct(i.cast("int").alias("at"), others.alias("others")))
            return F.transform(kid["below"], lambda b: F.struct(b["own"].alias("own"), F.when(several, F.concat(b["path"], step)).otherwise(b["path"]).alias("path")))

        preimage = F.array_join(F.transform(kids, lambda k: text_of(k["digest"])), "")
        digest = F.when(several, F.unhex(F.sha2(preimage, 256))).otherwise(F.col("digest"))
        at = at.select("grp", "total", "chunk", F.col("parent").alias("idx"), digest.alias("digest"), F.flatten(F.transform(kids, grown)).alias("below"))
    return at.select("grp", "chunk", F.shiftright(F.col("total") + ((1 << span) - 1), span).alias("total"), "digest", "below")


def climb(scratch: Scratch, nodes: DataFrame, span: int, name: str) -> list[DataFrame]:
    """Tables of rise() from the nodes up to one node a group."""
    tiers, most = [], None
    while most is None or most > 1:
        tiers.append(scratch.write(rise(nodes, span), name))
        most = tiers[-1].agg(F.max("total")).collect()[0][0] or 1
        nodes = tiers[-1].select("grp", F.col("chunk").alias("idx"), "total", "digest", F.struct(F.col("chunk").alias("idx")).alias("own"))
    return tiers


def descend(tiers: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """grp, own, path (up to the top), top of the first tier's nodes; above (grp, path, top) carries on at the groups' roots."""
    rows = None if above is None else above.select("grp", F.lit(0).cast("long").alias("chunk"), F.col("path").alias("rest"), "top")
    for tier in reversed(tiers):
        if rows is None:
            held = tier.withColumns({"rest": F.array().cast(PATH), "top": F.struct(F.col("digest").alias("root"))})
        else:
            held = tier.join(rows, ["grp", "chunk"])
        out = held.select("grp", "rest", "top", F.explode("below").alias("b")).select("grp", "b.own", F.concat("b.path", "rest").alias("path"), "top")
        rows = None if tier is tiers[0] else out.select("grp", F.col("own.idx").alias("chunk"), F.col("path").alias("rest"), "top")
    return out


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf (hex) leads to along its path."""

    def step(h: Column, e: Column) -> Column:
        others = text_of(e["others"])
        return F.sha2(F.when(e["at"] == 0, F.concat(h, others)).otherwise(F.concat(others, h)), 256)

    return F.aggregate(path, digest, step)


def manifest(spark: SparkSession, docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, leaf, used, subroot, root (hex) and path of every row of docs; used is the leaf of the row as tampered with."""
    scratch = Scratch(spark)
    found = scratch.write(leaves(docs), "leaves")
    nodes = numbered(spark, scratch, found, ["doc_id", "digest"], "ordered")
    nodes = nodes.select("grp", "idx", "total", "digest", F.struct("doc_id", F.col("digest").alias("leaf"), "used").alias("own"))
    tiers = climb(scratch, nodes, span, "tiers")
    scratch.drop("leaves", "ordered")
    subroots = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "digest")
    tops = numbered(spark, scratch, subroots, ["lang"], "subroots")
    tops = tops.select("grp", "idx", "total", "digest", F.struct("lang", F.col("digest").alias("subroot")).alias("own"))
    above = descend(climb(scratch, tops, span, "top"))
    above = above.select(F.col("own.lang").alias("grp"), "path", F.struct(F.col("own.subroot").alias("subroot"), F.col("top.root").alias("root")).alias("top"))
    out = descend(tiers, above)
    return out.select("own.doc_id", text_of(F.col("own.leaf")).alias("leaf"), text_of(F.coalesce("own.used", "own.leaf")).alias("used"), text_of(F.col("top.subroot")).alias("subroot"), text_of(F.col("top.root")).alias("root"), "path")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verdict of every document."""
    out = manifest(spark, table(spark, sf_dir, "documents"))
    proof = F.sha2(text_of(joined(F.transform("path", lambda e: e["others"]))), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("used"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)
  )
), d AS (
  SELECT doc_id, n_chars, coalesce('=' || lang, '-') AS grp,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit
  FROM documents CROSS JOIN tab
), l AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS used
  FROM d
), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS m FROM l),
n AS (
  SELECT grp, 0 AS lvl, idx, leaf AS h, m FROM p
  UNION ALL
  SELECT grp, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (m + 1) // 2 FROM n WHERE m > 1 GROUP BY grp, lvl, idx // 2, m
), s AS (SELECT grp, lvl AS tall, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS m FROM n WHERE m = 1),
g AS (
  SELECT 0 AS lvl, idx, subroot AS h, m FROM s
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (m + 1) // 2 FROM g WHERE m > 1 GROUP BY lvl, idx // 2, m
), steps AS (
  SELECT p.grp, p.idx, k.lvl, ((p.idx >> k.lvl) & 1) AS side, coalesce(n.h, '') AS others
  FROM p JOIN (SELECT DISTINCT grp, lvl FROM n WHERE m > 1) k USING (grp) LEFT JOIN n ON n.grp = p.grp AND n.lvl = k.lvl AND n.idx = xor((p.idx >> k.lvl)::BIGINT, 1)
  UNION ALL
  SELECT p.grp, p.idx, s.tall + k.lvl, ((s.idx >> k.lvl) & 1), coalesce(g.h, '')
  FROM p JOIN s USING (grp) CROSS JOIN (SELECT DISTINCT lvl FROM g WHERE m > 1) k LEFT JOIN g ON g.lvl = k.lvl AND g.idx = xor((s.idx >> k.lvl)::BIGINT, 1)
), proofs AS (SELECT grp, idx, string_agg(others, '' ORDER BY lvl) AS proof, list(side ORDER BY lvl) AS sides, list(others ORDER BY lvl) AS sibs, count(*) AS k FROM steps GROUP BY grp, idx),
f AS (
  SELECT p.grp, p.idx, 0 AS lvl, coalesce(used, leaf) AS h FROM p
  UNION ALL
  SELECT f.grp, f.idx, lvl + 1, sha256(CASE WHEN sides[lvl + 1] = 0 THEN h || sibs[lvl + 1] ELSE sibs[lvl + 1] || h END) FROM f JOIN proofs USING (grp, idx) WHERE lvl < k
), top AS (SELECT h AS root FROM g WHERE m = 1)
SELECT p.doc_id, p.leaf, s.subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM p JOIN s USING (grp) CROSS JOIN top LEFT JOIN proofs q ON q.grp = p.grp AND q.idx = p.idx JOIN f ON f.grp = p.grp AND f.idx = p.idx AND f.lvl = coalesce(q.k, 0)
"""
