"""Merkle manifests of datasets: a hash tree for each group of rows, one above the groups, and a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etlspec.llm.common import column, forget, stored

#: Children of a node.
FANOUT = 16
#: Digits of the rank that are grouped away in one block: it nests FANOUT ** BLOCK_DIGITS leaves at most.
BLOCK_DIGITS = 3

_LINK = "struct<before:string,after:string>"


def digest(*texts: Column) -> Column:
    """Lower-case hex SHA-256 of the texts' UTF-8 bytes, one after another."""
    return F.sha2(F.concat(*texts), 256)


def leaf_digest(*values: Column) -> Column:
    """The hash of a row: each value as ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, proof: Column | str) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda now, link: digest(link["before"], now, link["after"]))


def proof_digest(proof: Column | str) -> Column:
    """The hash of all siblings in a proof, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda link: F.concat(link["before"], link["after"])), ""), 256)


def manifest(
    rows: DataFrame,
    *,
    leaf_col: str = "leaf",
    group_col: str = "source",
    order_col: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row: its place in a hash tree, and the proof that leads to the root.

    Columns: ``group_col``, ``order_col``, ``leaf_col``, the columns in ``keep``;
    ``rank`` in the group, from 0; ``subroot``, its group's root; ``root``; and
    ``proof``, array<struct<before, after>>: for each level from the leaf up, the
    siblings to its left and right, as hex digits one after another.

    In each group the leaves ascend by ``order_col`` (null first). While more
    than one node is left, each run of 16 becomes the hash of their hashes; the
    last run may be shorter, even one. The groups' roots, by ``group_col`` (null
    first, by UTF-8 bytes), give the root in the same way.

    Ranks come from a range partitioning of all rows: a row's number in its
    partition, and the running sums of the partitions' counts. The digits of the
    rank are then grouped away, the last one first, each time nesting the child
    structs in their parent's row. Three digits make a block: 4,096 leaves or
    fewer in one row. The roots of blocks are rolled up in the same way, until
    one is left for each group. Proofs go from the top down: each nested row is
    exploded level by level, siblings added to the proof. A block meets the proof
    of its own root by its key in a union; nothing is joined there. The
    number of rounds is the logarithm of the largest group to the base 4,096.
    Each round is kept as Parquet in shared storage, so a lost executor costs
    the tasks it ran.

    No task sees a whole group: a hot one has many blocks. Equal rows and equal
    ids are ordered by their leaf, and equal leaves in any order, which changes
    no hash; range partitions are cut inside them too. Null groups are one group,
    and a null leaf stands for the hash of an empty text. An empty table gives no
    rows. Columns of ``keep`` travel in the nested rows, so they should be short;
    they can't hold maps. Other columns are not used.
    """
    for name in keep:
        if "map<" in rows.select(column(rows, name)).schema[0].dataType.simpleString():
            raise ValueError(f"column {name} holds a map, which has no order")
    extra = F.struct(*[column(rows, n) for n in keep]) if keep else F.struct(F.lit(None).cast("string").alias("nothing"))
    leaf = F.coalesce(column(rows, leaf_col).cast("string"), F.sha2(F.lit(""), 256))
    slim = rows.select(
        column(rows, group_col).alias("g"),
        column(rows, order_col).alias("o"),
        leaf.alias("h"),
        extra.alias("extra"),
        F.monotonically_increasing_id().alias("salt"),  # lets a range end between equal rows
    )
    slim = stored(slim)
    ranked, deepest = _ranked(slim, ["o", "h", "salt"])
    forget(slim)
    blocks = _roll(ranked.select("g", "levels", "rank", "h", F.struct("o", "extra").alias("leaf")), deepest)
    forget(ranked)

    tops = blocks[-1].select("g", "h")
    one = tops.select(F.lit(0).alias("g"), F.col("g").alias("group"), "h")
    ordered, high = _ranked(one, ["group"])
    above = _roll(ordered.select("g", "levels", "rank", "h", F.struct("group").alias("leaf")), high)
    forget(ordered)
    none = F.array().cast(f"array<{_LINK}>")
    start = above[-1].select("g", F.col("h").alias("root"), F.lit(None).cast("string").alias("subroot"), F.lit(0).cast("long").alias("block"), none.alias("proof"))
    of_groups = _unroll(above, start)
    groups = of_groups.select(
        F.col("leaf.group").alias("g"), "root", F.col("h").alias("subroot"), F.lit(0).cast("long").alias("block"), "proof"
    )
    found = _unroll(blocks, groups)
    return found.select(
        F.col("g").alias(group_col),
        F.col("leaf.o").alias(order_col),
        F.col("h").alias(leaf_col),
        *[F.col("leaf.extra").getField(n).alias(n) for n in keep],
        "rank",
        "subroot",
        "root",
        "proof",
    )


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` in ``g`` and the ``levels`` of its tree, stored; and the most levels of all."""
    keys = ["g", *order]
    at = F.monotonically_increasing_id()  # the partition, and the row's number in it
    cut = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", at).withColumn("part", F.shiftright("at", 33)))
    inside = Window.partitionBy("g")  # as many rows as partitions hold rows of g
    before = F.coalesce(F.sum("n").over(inside.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(inside)
    levels = sum(((total > FANOUT**k).cast("int") for k in range(16)), F.lit(0))
    counts = cut.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    places = stored(counts.select(F.col("g").alias("g_"), F.col("part").alias("part_"), (before - F.col("first")).alias("shift"), levels.alias("levels")))
    deepest = places.agg(F.coalesce(F.max("levels"), F.lit(0))).first()[0]
    joined = cut.join(places, cut["g"].eqNullSafe(F.col("g_")) & (F.col("part") == F.col("part_")))
    out = stored(joined.select(*rows.columns, "levels", (F.col("at") + F.col("shift")).alias("rank")))
    forget(cut, places)
    return out, deepest


def _roll(nodes: DataFrame, deepest: int) -> list[DataFrame]:
    """The blocks of each round, stored: (g, levels, block, h, kids), ``kids`` nested down to the round's nodes.

    ``nodes`` are (g, levels, rank, h, leaf).
    """
    rounds = []
    while not rounds or deepest > BLOCK_DIGITS * len(rounds):
        base = BLOCK_DIGITS * len(rounds)
        digits = [F.shiftright("rank", 4 * k).bitwiseAND(F.lit(FANOUT - 1)).cast("int").alias(f"d{k}") for k in range(BLOCK_DIGITS)]
        now = nodes.withColumn("block", F.shiftright("rank", 4 * BLOCK_DIGITS)).select("g", "levels", "block", *digits, "h", F.col("leaf").alias("kids"))
        now = now.repartition("g", "block")  # the only exchange: all groupings below keep these keys
        for k in range(BLOCK_DIGITS):
            higher = [f"d{j}" for j in range(k + 1, BLOCK_DIGITS)]
            child = F.struct(F.col(f"d{k}").alias("d"), "h", "kids")
            now = now.groupBy("g", "levels", "block", *higher).agg(F.sort_array(F.collect_list(child)).alias("kids"))
            hashes = F.transform("kids", lambda kid: kid["h"])
            h = F.when(F.col("levels") > base + k, F.sha2(F.array_join(hashes, ""), 256)).otherwise(F.get(hashes, F.lit(0)))
            now = now.withColumn("h", h)
        rounds.append(stored(now.select("g", "levels", "block", "h", "kids")))
        nodes = rounds[-1].select("g", "levels", F.col("block").alias("rank"), "h", F.lit(None).cast("string").alias("leaf"))
    return rounds


def _unroll(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, levels, rank, h, leaf, subroot, root, proof) of all leaves of ``rounds``.

    ``above`` has (g, block, subroot, root, proof) for the one block of each g in the last round.
    """
    for r in reversed(range(len(rounds))):
        base = BLOCK_DIGITS * r
        blocks, info = rounds[r], F.struct("subroot", "root", "proof")
        tree = F.struct("levels", "kids")
        both = blocks.select("g", "block", tree.alias("tree"), F.lit(None).cast(above.select(info.alias("x")).schema[0].dataType).alias("info")).unionByName(
            above.select("g", "block", F.lit(None).cast(blocks.select(tree.alias("x")).schema[0].dataType).alias("tree"), info.alias("info"))
        )
        met = both.groupBy("g", "block").agg(F.get(F.collect_list("tree"), F.lit(0)).alias("tree"), F.get(F.collect_list("info"), F.lit(0)).alias("info"))
        now = met.select("g", "tree.levels", F.col("block").alias("rank"), "tree.kids", "info.subroot", "info.root", "info.proof")
        for k in reversed(range(BLOCK_DIGITS)):
            rest = ["g", "levels", "subroot", "root"]
            now = now.select(*rest, "rank", "proof", F.transform("kids", lambda kid: kid["h"]).alias("hashes"), F.posexplode("kids").alias("p", "kid"))
            left, right = F.slice("hashes", F.lit(1), F.col("p")), F.slice("hashes", F.col("p") + 2, F.size("hashes"))
            link = F.struct(F.array_join(left, "").alias("before"), F.array_join(right, "").alias("after")).cast(_LINK)
            proof = F.when(F.col("levels") > base + k, F.concat(F.array(link), "proof")).otherwise(F.col("proof"))
            now = now.select(*rest, (F.col("rank") * FANOUT + F.col("kid.d")).alias("rank"), proof.alias("proof"), F.col("kid.h").alias("h"), F.col("kid.kids").alias("kids"))
        below = now.withColumnRenamed("kids", "leaf")
        above = below.select("g", F.col("rank").alias("block"), "subroot", "root", "proof")
    return below


def manifest_sql(levels: int = 6) -> str:
    """SQL over ``documents`` for the query of this operator, for groups, and groups of groups, of up to ``levels`` levels."""
    told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    fields = [told(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: "sha256(" + " || ".join([*fields, told(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        # crc32 without a function for it: eight shifts a byte
        """crc AS (SELECT doc_id, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)) AS v
            FROM documents)""",
        f"""d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(lower)} AS tampered, xor(v, 4294967295::BIGINT) % 5 = 0 AS changed
            FROM documents JOIN crc USING (doc_id))""",
        "a0 AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, leaf AS h FROM d)",
    ]

    def tree(name: str) -> None:
        for k in range(levels):
            ctes.append(f"{name}n{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {name}{k})")
            ctes.append(
                f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}n{k} GROUP BY g, i // 16)"
            )
            ctes.append(
                f"""{name}s{k} AS (SELECT g, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                    coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, n > 1 AS real FROM {name}n{k})"""
            )

    tree("a")
    ctes.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM a{levels})")
    tree("b")
    ctes.append(f"place AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS j FROM a{levels})")
    ctes.append(
        f"""step0 AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, j, subroot, (SELECT h FROM b{levels}) AS root,
            '' AS proof, CASE WHEN changed THEN tampered ELSE leaf END AS fold FROM d JOIN place ON source IS NOT DISTINCT FROM g)"""
    )
    for m, (name, k) in enumerate([("a", k) for k in range(levels)] + [("b", k) for k in range(levels)]):
        on, at = ("x.source IS NOT DISTINCT FROM s.g", "x.i") if name == "a" else ("TRUE", "x.j")
        ctes.append(
            f"""step{m + 1} AS (SELECT x.* EXCLUDE (proof, fold), CASE WHEN real THEN proof || l || r ELSE proof END AS proof,
                CASE WHEN real THEN sha256(l || fold || r) ELSE fold END AS fold FROM step{m} x JOIN {name}s{k} s ON {on} AND {at} // {16**k} = s.i)"""
        )
    return f"""WITH {', '.join(ctes)}
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM step{2 * levels}"""
