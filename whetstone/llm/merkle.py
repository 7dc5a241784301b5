"""A Merkle manifest of a dataset: a tree of digests by part of the data, with a proof for each row.

Nodes of a level are rows with their place. A node's slot is its place modulo the fan-out, and its siblings stand at
computed places: the slot-zero rows join those at place + 1, + 2 and so on, each an equijoin on the run, and emit the
parents (with a fan-out of two that place is place XOR 1). Proofs go down the same rows: each run adds its siblings to the
proof of its parent, so a proof is built once for a run and not once for a row until the last step.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whetstone.llm import common as C

#: Nodes that make one parent.
FAN_OUT = 8
#: Nodes of a level that one task joins: the top levels of a tree are small.
SMALL = 10_000
#: One step of a proof: the digests before and after the node's own, as bytes.
STEP = "struct<before:binary,after:binary>"


def digest(*columns: Column) -> Column:
    """SHA-256, as bytes, of the columns one after the other: `-` for null, else UTF-8 length, `:` and value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _text(b: Column) -> Column:
    return F.lower(F.hex(b))


def _parent(texts: Column) -> Column:
    return F.unhex(F.sha2(texts, 256))


def runs(nodes: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(part, run, h, hs): each run of `fan_out` nodes of a part with its parent's digest. nodes: part, i, h and further columns, kept in hs."""
    more = [c for c in nodes.columns if c not in ("part", "i", "n")]
    # nulls are a part of their own, so the key of the joins holds whether the part is null
    keyed = nodes.select(F.col("part").isNull().alias("none"), F.coalesce("part", F.lit("")).alias("of"), F.floor(F.col("i") / fan_out).alias("run"), (F.col("i") % fan_out).alias("slot"), F.struct(*more).alias("x"))
    out = keyed.where("slot = 0").drop("slot").withColumnRenamed("x", "x0")
    for k in range(1, fan_out):
        # place = run * fan_out + k, from slot zero's place + k
        # all joins have one key, so the rows are dealt once; merged, as a broadcast for each slot of each level would fill the driver
        out = out.join(keyed.where(F.col("slot") == k).drop("slot").withColumnRenamed("x", f"x{k}").hint("merge"), ["none", "of", "run"], "left")
    hs = F.array_compact(F.array(*[F.col(f"x{k}") for k in range(fan_out)]))
    named = out.select(F.when(~F.col("none"), F.col("of")).alias("part"), "run", hs.alias("hs"))
    return named.withColumn("h", _parent(F.array_join(F.transform("hs", lambda x: _text(x["h"])), "")))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the steps of its proof give."""
    return F.aggregate(path, leaf, lambda h, s: _parent(F.concat(_text(s["before"]), _text(h), _text(s["after"]))))


def proof(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_text(s["before"]), _text(s["after"]))), ""), 256)


def _climb(leaves: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level, the top node of each part) over leaves (part, i, n, h, more); n is how many nodes the part has."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, tops, grown = leaves, [leaves.where("n = 1").select("part", "h")], []
    while most > 1:
        if level.count() <= SMALL:
            level = level.coalesce(1)
        made = C.durable(runs(level.where("n > 1"), fan_out).join(level.where("i = 0 and n > 1").select(F.col("part").alias("of"), "n"), F.col("part").eqNullSafe(F.col("of"))).drop("of"))
        grown.append(made)
        level = made.select("part", F.col("run").alias("i"), F.ceil(F.col("n") / fan_out).alias("n"), "h")
        tops.append(level.where("n = 1").select("part", "h"))
        most = -(-most // fan_out)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return grown, C.durable(top)


def _paths(made: DataFrame, above: DataFrame, fan_out: int) -> DataFrame:
    """Rows of a level with their path: own run's siblings, then the path of the parent. above: part, i, path."""
    up = above.select(F.col("part").alias("of"), F.col("i").alias("run"), F.col("path").alias("up"))
    both = made.join(up, F.col("part").eqNullSafe(F.col("of")) & (made["run"] == up["run"])).select("part", made["run"], "hs", "up")
    side = lambda a, n: F.concat_ws("", F.transform(F.slice("hs", a, n), lambda x: F.hex(x["h"])))
    rows = both.select("part", "run", "hs", "up", F.posexplode("hs").alias("slot", "x"))
    step = F.struct(F.unhex(side(F.lit(1), F.col("slot"))).alias("before"), F.unhex(side(F.col("slot") + 2, F.lit(fan_out))).alias("after"))
    return rows.select("part", (F.col("run") * fan_out + F.col("slot")).alias("i"), F.concat(F.array(step).cast(f"array<{STEP}>"), F.col("up")).alias("path"), "x.*")


def manifest(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fan_out: int = FAN_OUT, checked: dict[str, Column] | None = None) -> DataFrame:
    """(part, doc_id, leaf, subroot, root, path, checked_leaf) of each row: its digest, its part's and the dataset's, and its proof.

    Leaves of a part ascend by id (null first; equal ids by digest), parts ascend with null first. `checked` maps columns
    to what a later copy of the data holds in them: checked_leaf is the digest with these, to be folded along the path.
    Null and empty values have different digests; repeated rows are leaves of their own; a part of one row is its own subroot;
    no rows give none. Texts of any length are hashed whole; other columns are ignored, and none may clash.
    """
    own = digest(*(docs[c] for c in columns))
    other = digest(*((checked or {}).get(c, docs[c]) for c in columns))
    # written first, as a sort by ranges reads its input twice and the texts should be hashed once
    rows = C.durable(docs.select(docs[part_col].cast("string").alias("part"), docs[id_col].cast("long").alias("doc_id"), own.alias("h"), other.alias("other")))
    placed = C.numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("h")], "part")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    leaves = C.durable(placed.join(F.broadcast(counts.withColumnRenamed("part", "of")) if counts.count() <= 10_000 else counts.withColumnRenamed("part", "of"), F.col("part").eqNullSafe(F.col("of"))).drop("of"))
    grown, subroots = _climb(leaves, fan_out)
    # the parts themselves are the leaves of one more tree
    parts = C.numbered(subroots.select(F.col("part").alias("name"), "h"), [F.col("name").asc_nulls_first()]).withColumn("part", F.lit("all"))
    parts = C.durable(parts.withColumn("n", F.lit(parts.count())))
    over, roots = _climb(parts.select("part", "i", "n", "h", "name"), fan_out)
    top = parts.where("n = 1").select("part", "i", "h", "name") if not over else None
    paths = roots.select("part", F.lit(0).cast("long").alias("i"), F.array().cast(f"array<{STEP}>").alias("path"))
    for made in reversed(over):
        paths = _paths(made, paths, fan_out)
    if top is not None:
        paths = paths.join(top.drop("i"), "part")
    root = roots.select(_text(F.col("h")).alias("h")).first()  # one row
    by_part = C.durable(paths.select(F.col("name").alias("part"), "path", F.col("h").alias("subroot"), F.unhex(F.lit(root["h"] if root else None).cast("string")).alias("root")))
    paths = by_part.select("part", F.lit(0).cast("long").alias("i"), "path")
    alone = leaves.where("n = 1").select("part", "i", "doc_id", "h", "other")
    out = alone.join(paths.withColumnRenamed("part", "of").drop("i"), F.col("part").eqNullSafe(F.col("of"))).select("part", "doc_id", "h", "other", "path")
    # from the top level down; parts with fewer levels join theirs where these begin
    here = None
    for level in range(len(grown) - 1, -1, -1):
        tops = paths.withColumnRenamed("part", "of").join(grown[level].where(F.col("n") <= fan_out).select("part"), F.col("part").eqNullSafe(F.col("of"))).select("part", "i", "path")
        above = tops if here is None else here.select("part", "i", "path").unionByName(tops)
        here = _paths(grown[level], above, fan_out)
    if here is not None:
        out = out.unionByName(here.select("part", "doc_id", "h", "other", "path"))
    named = by_part.select(F.col("part").alias("of"), "subroot", "root")
    full = out.join(named, F.col("part").eqNullSafe(F.col("of")))
    return full.select("part", "doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", F.col("other").alias("checked_leaf"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def audited(docs: DataFrame, checked: dict[str, Column] | None = None, **how) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests as lowercase hex: `manifest`, with each row's copy checked against the root by its proof."""
    rows = manifest(docs, checked=checked, **how).withColumn("folded", folded(F.col("checked_leaf"), F.col("path")))
    return rows.select("doc_id", *(_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), proof(F.col("path")).alias("proof_sha256"), _text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


#: The registered query in SQL: levels by grouping places, then every leaf's copy folded upwards level by level.
ORACLE = """
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) x(i))),
docs AS (SELECT *, coalesce(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 3 = 0, false) AS hit FROM documents, crc_table),
texts AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
 CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM docs),
hashes AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS copy FROM texts),
leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS part, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf, copy FROM hashes),
tree AS (SELECT part, 0 AS level, i, n, leaf AS h FROM leaves
 UNION ALL SELECT part, min(level) + 1, i // 8, min((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY part, i // 8),
subroots AS (SELECT part, h AS subroot, part - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (SELECT 0 AS level, i, n, subroot AS h FROM subroots
 UNION ALL SELECT min(level) + 1, i // 8, min((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY i // 8),
sides AS (SELECT a.part, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after FROM tree a JOIN tree b ON a.part = b.part AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY 1, 2, 3),
crown_sides AS (SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after FROM crown a JOIN crown b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY 1, 2),
fold AS (SELECT part, i AS leaf_i, i, 0 AS level, copy AS h, '' AS seen, n FROM leaves
 UNION ALL SELECT f.part, f.leaf_i, f.i // 8, f.level + 1, sha256(s.before || f.h || s.after), f.seen || s.before || s.after, (f.n + 7) // 8 FROM fold f JOIN sides s ON s.part = f.part AND s.level = f.level AND s.i = f.i WHERE f.n > 1),
over AS (SELECT f.part, leaf_i, s.i, 0 AS level, f.h, seen, s.n FROM fold f JOIN subroots s USING (part) WHERE f.n = 1
 UNION ALL SELECT o.part, o.leaf_i, o.i // 8, o.level + 1, sha256(s.before || o.h || s.after), o.seen || s.before || s.after, (o.n + 7) // 8 FROM over o JOIN crown_sides s ON s.level = o.level AND s.i = o.i WHERE o.n > 1),
root AS (SELECT h AS root FROM crown WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, root, sha256(o.seen) AS proof_sha256, o.h AS folded_root, o.h = root AS verified
FROM leaves l JOIN subroots s USING (part) JOIN over o ON o.part = l.part AND o.leaf_i = l.i AND o.n = 1, root
"""
