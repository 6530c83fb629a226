"""Merkle manifest of a dataset: leaves by source, subroots, a root, and each leaf's proof.

Method: coordinate lookup proofs. Every ``ARITY`` consecutive nodes of a level become one of the next, so a node's siblings
follow from its index and the group size alone. Leaves explode the coordinates of the siblings that they need, join
the materialised node table, and order, concatenate and fold what they find.

Plan: leaves are hashed in one scan and written. Their places within a source come from range partitions, whose rows are
numbered, and one count per partition and source, so no source is sorted in one task. Nodes are made ``STRIDE`` levels at a time: a block
of ``ARITY ** STRIDE`` consecutive nodes (27) is one bounded group that gives all its levels. Coordinates are looked up by the same strides:
the nodes of every ``STRIDE``-th level look up the siblings of the levels up to the next such level, and then
take over what their ancestor there found. So a leaf looks up 6 siblings and not all of them; a
node is asked for by 54 rows at most, though those near a root belong to a third of all proofs; and each
stride's tables are 27 times smaller than the one's before. Nothing is collected or broadcast by the operator but the size of the largest tree.

Defined results: all columns may be null (written as ``-``); a null ``doc_id`` comes first in its source and is never tampered
with, a null ``source`` is a source of its own that comes first. Rows that repeat a ``doc_id`` are leaves of their own, in
the order of their hashes. A source of one leaf has it as its subroot; a dataset of one source has its subroot as root. An
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import Scratch

ARITY = 3
STRIDE = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """A value with its size in bytes before it, so that no two rows of fields read alike; ``-`` if null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexes(digests: Column) -> Column:
    """An array of digests as one hex text."""
    return F.lower(F.array_join(F.transform(digests, F.hex), ""))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, changed): ``changed`` is the leaf of the tampered text. ``tree`` sorts as the sources do, null first."""
    of = {c: field(F.col(c)) for c in FIELDS}
    struck = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.col("text").cast("string")
    tampered = F.when(struck, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    first = [of[c] for c in FIELDS[:-1]]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), digest(F.concat(*first, of["text"])).alias("leaf"), digest(F.concat(*first, field(tampered))).alias("changed"))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``idx``, the place within their ``tree`` by ``order``, and ``n``, the tree's size.

    ``order`` must tell rows apart, so that ranges of equal size can be cut. Numbers are those of the written table: a
    task that runs again gives the same ones.
    """
    keys = ["tree", *order]
    placed = scratch.stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftright("at", 33)
    runs = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("tree")  # as many rows as there are range partitions
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n"))
    return placed.withColumn("part", part).join(runs, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _nodes_at(level: int) -> Column:
    """How many nodes a tree of ``n`` leaves has at a level."""
    span = ARITY**level
    return F.call_function("div", F.col("n") + (span - 1), F.lit(span)) if level else F.col("n")


def _up(index: Column, levels: int) -> Column:
    """The index of the ancestor so many levels above."""
    return F.call_function("div", index, F.lit(ARITY**levels)) if levels else index


def _folded(nodes: Column) -> Column:
    """The next level of a block's nodes."""
    groups = F.sequence(F.lit(0), F.ceil(F.size(nodes) / ARITY).cast("int") - 1)
    return F.transform(groups, lambda g: digest(hexes(F.slice(nodes, g * ARITY + 1, F.lit(ARITY)))))


class Forest:
    """All trees of a table (tree, idx, n, hash) of leaves, built stride by stride.

    ``strides[s]`` is (nodes at level s * STRIDE, nodes of that level and the ones up to the next stride); a tree is in it as long
    as it has more than one node there. ``tops`` is (tree, root).
    """

    def __init__(self, base: DataFrame, scratch: Scratch):
        self.scratch = scratch
        largest = base.agg(F.max("n")).first()[0] or 0
        tops, nodes, level = [], base, 0
        self.strides: list[tuple[DataFrame, DataFrame]] = []
        while True:
            # What has one node here is done
            tops.append(nodes.where(_nodes_at(level) <= 1).select("tree", F.col("hash").alias("root")))
            if -(-largest // ARITY**level) <= 1:
                break
            nodes = nodes.where(_nodes_at(level) > 1)
            table, nodes_up = self._stride(nodes, level)
            self.strides.append((nodes, table))
            nodes, level = nodes_up, level + STRIDE
        self.tops = tops[0]
        for t in tops[1:]:
            self.tops = self.tops.unionByName(t)

    def _stride(self, nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        block = nodes.groupBy("tree", "n", _up(F.col("idx"), STRIDE).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash")))["hash"].alias("l0"))
        for k in range(STRIDE):
            more = _nodes_at(level + k) > 1  # else the tree ends below this level
            block = block.withColumn(f"l{k + 1}", F.when(more, _folded(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
        at = lambda k: F.transform(f"l{k}", lambda h, i: F.struct(F.lit(level + k).alias("level"), (F.col("block") * ARITY ** (STRIDE - k) + i).alias("sibling"), h.alias("hash")))
        levels = [F.when(_nodes_at(level + k) > 1, at(k)) for k in range(STRIDE)]
        top = F.struct(F.lit(level + STRIDE).alias("level"), F.col("block").alias("sibling"), F.element_at(f"l{STRIDE}", 1).alias("hash"))
        whole = F.concat(*[F.coalesce(x, F.array().cast("array<struct<level:int,sibling:bigint,hash:binary>>")) for x in levels], F.array(top))
        table = self.scratch.stored(block.select("tree", "n", F.inline(whole)), "merkle-nodes")
        up = table.where(F.col("level") == level + STRIDE).select("tree", F.col("sibling").alias("idx"), "n", "hash")
        return table.where(F.col("level") < level + STRIDE).select("tree", "level", "sibling", "hash"), up

    def proofs(self, leaves: DataFrame, tops: DataFrame) -> DataFrame:
        """(tree, idx, steps, ...): from each leaf to the top, each step the own place in the run and the others' digests.

        ``tops`` has, by ``tree``, the ``steps`` that follow above the tree, and further columns that go down to its leaves.
        """
        got, rest = None, [c for c in tops.columns if c not in ("tree", "steps")]
        for s in range(max(0, len(self.strides) - 1), -1, -1):
            level = s * STRIDE
            entities = leaves if not s else self.strides[s][0]
            own = self._looked_up(entities.select("tree", "idx", "n"), s, level)
            ends = entities.where(_nodes_at(level + STRIDE) <= 1).select("tree").distinct() if s else leaves.where(_nodes_at(STRIDE) <= 1).select("tree").distinct()
            above = ends.join(tops, "tree").select("tree", F.lit(0).cast("long").alias("up"), F.col("steps").alias("more"), *rest)
            if got is not None:
                above = above.unionByName(got.select("tree", F.col("idx").alias("up"), F.col("steps").alias("more"), *rest))
            got = own.withColumn("up", _up(F.col("idx"), STRIDE)).join(above, ["tree", "up"]).select("tree", "idx", F.concat("steps", "more").alias("steps"), *rest)
            if s:
                got = self.scratch.stored(got, "merkle-paths")
        return got

    @staticmethod
    def _of_level(level: int) -> Column:
        return F.transform(F.filter("found", lambda x: x["level"] == level), lambda x: x["hash"])

    def _looked_up(self, entities: DataFrame, s: int, level: int) -> DataFrame:
        """(tree, idx, steps) of this stride: coordinates of siblings, exploded and joined with the node table."""
        if s >= len(self.strides):
            return entities.select("tree", "idx", F.array().cast("array<struct<place:int,others:array<binary>>>").alias("steps"))
        coordinate, steps = [], []
        for k in range(STRIDE):
            own = _up(F.col("idx"), k)
            there = _nodes_at(level + k)
            first = _up(F.col("idx"), k + 1) * ARITY
            for i in range(ARITY):
                wanted = F.struct(F.lit(level + k).alias("level"), (first + i).alias("sibling"))
                coordinate.append(F.when((there > 1) & (first + i != own) & (first + i < there), wanted))
            place = (own - first).cast("int").alias("place")
            steps.append(F.when(there > 1, F.struct(place, self._of_level(level + k).alias("others"))))
        # The last coordinate is nobody's: it keeps nodes without siblings
        asked = F.concat(F.array_compact(F.array(*coordinate)), F.array(F.struct(F.lit(-1).alias("level"), F.col("idx").alias("sibling"))))
        asked_rows = entities.select("tree", "idx", "n", F.inline(asked))
        found = asked_rows.join(self.strides[s][1], ["tree", "level", "sibling"], "left")
        hit = F.when(F.col("hash").isNotNull(), F.struct("level", "sibling", "hash"))
        got = found.groupBy("tree", "idx", "n").agg(F.array_sort(F.collect_list(hit)).alias("found"))
        return got.select("tree", "idx", F.array_compact(F.array(*steps)).alias("steps"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps, as hex."""

    def up(own: Column, step: Column) -> Column:
        others = F.transform(step["others"], lambda d: F.lower(F.hex(d)))
        return F.sha2(F.concat(F.array_join(F.slice(others, F.lit(1), step["place"]), ""), own, F.array_join(F.slice(others, step["place"] + 1, F.lit(ARITY)), "")), 256)

    return F.aggregate(steps, F.lower(F.hex(leaf)), up)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source tree, leaf, changed, subroot, root, steps) of each row: all digests binary, steps up to the root."""
    with Scratch(docs.sparkSession) as scratch:
        # Written rows have a number of their own, which tells equal ones apart
        hashed = scratch.stored(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
        placed = scratch.stored(numbered(hashed, ["doc_id", "leaf", "row"], scratch), "merkle-numbered")
        forest = Forest(placed.select("tree", "idx", "n", F.col("leaf").alias("hash")), scratch)
        subroots = scratch.stored(forest.tops, "merkle-subroots")
        ranked = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("hash")), ["name"], scratch)
        ranked = scratch.stored(ranked, "merkle-ranked")
        crown = Forest(ranked.select("tree", "idx", "n", "hash"), scratch)
        nothing = F.array().cast("array<struct<place:int,others:array<binary>>>")
        upper = crown.proofs(ranked, crown.tops.select("tree", nothing.alias("steps"), "root"))
        tops = ranked.drop("tree", "n").join(upper.drop("tree"), "idx").select(F.col("name").alias("tree"), "steps", F.col("hash").alias("subroot"), "root")
        tops = scratch.stored(tops, "merkle-tops")
        paths = forest.proofs(placed, tops)
        return scratch.kept(placed.drop("row", "n").join(paths, ["tree", "idx"]), "merkle-manifest")


def verified_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): proofs of the untampered rows, held against tampered ones."""
    text = lambda c: F.lower(F.hex(c))
    got = manifest(docs).withColumn("folded_root", folded(F.col("changed"), F.col("steps")))
    siblings = F.flatten(F.transform("steps", lambda s: s["others"]))
    return got.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(hexes(siblings), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == text("root")).alias("verified"),
    )


def duckdb_sql() -> str:
    """The same rows, level by level, with the CRC of the ids' digits computed bit by bit."""

    def part(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"

    first = " || ".join(part(c) for c in FIELDS[:-1])
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)"
    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256({first} || {part("text")}) AS leaf,
         sha256({first} || {part(f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, n, idx // 3
), subroots AS (
  SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS level, idx, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY level, n, idx // 3
), runs AS (
  SELECT tree, level, idx // 3 AS run, list(hash ORDER BY idx) AS hashes FROM nodes WHERE n > 1 GROUP BY ALL
), crown_runs AS (
  SELECT level, idx // 3 AS run, list(hash ORDER BY idx) AS hashes FROM crown WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.tree, p.idx, r.level, CAST(p.idx // CAST(power(3, r.level) AS BIGINT) % 3 AS INT) AS place, r.hashes
  FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.idx // CAST(power(3, r.level + 1) AS BIGINT)
), crown_steps AS (
  SELECT s.tree, r.level, CAST(s.idx // CAST(power(3, r.level) AS BIGINT) % 3 AS INT) AS place, r.hashes
  FROM subroots s JOIN crown_runs r ON r.run = s.idx // CAST(power(3, r.level + 1) AS BIGINT)
), parts AS (
  SELECT tree, idx, level, place, hashes FROM steps
  UNION ALL
  SELECT p.tree, p.idx, 1000 + c.level, c.place, c.hashes FROM placed p JOIN crown_steps c ON c.tree = p.tree
), cut AS (
  SELECT tree, idx, level, array_to_string(hashes[1:place], '') AS before, array_to_string(hashes[place + 2:], '') AS after FROM parts
), paths AS (
  SELECT tree, idx, list(struct_pack(before := before, after := after) ORDER BY level) AS path FROM cut GROUP BY ALL
), folding AS (
  SELECT p.tree, p.idx, 1 AS nth, p.changed AS hash, coalesce(h.path, []) AS path FROM placed p LEFT JOIN paths h ON h.tree = p.tree AND h.idx = p.idx
  UNION ALL
  SELECT tree, idx, nth + 1, sha256(path[nth].before || hash || path[nth].after), path FROM folding WHERE nth <= len(path)
)
SELECT p.doc_id, p.leaf, s.hash AS subroot, c.hash AS root, sha256(array_to_string(list_transform(f.path, lambda x: x.before || x.after), '')) AS proof_sha256,
       f.hash AS folded_root, f.hash = c.hash AS verified
FROM placed p JOIN folding f ON f.tree = p.tree AND f.idx = p.idx AND f.nth = len(f.path) + 1
JOIN subroots s ON s.tree = p.tree CROSS JOIN (SELECT hash FROM crown WHERE n = 1) c
"""
