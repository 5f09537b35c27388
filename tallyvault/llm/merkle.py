"""A Merkle manifest of a dataset: every row's leaf, its group's root, the dataset's root, and a proof a row.

Method: bottom-up build, top-down proof push.  Rows become leaves, and the leaves of a
group stand in an order.  A level of parents is written from the level below it, two
children a parent, until each group has one node left; the groups' roots then go up the
same way to one.  Proofs come down: each level joins its nodes to their parents, and a
child puts its sibling before the proof that its parent has inherited.

No level is gathered: places in a group come from a sort by range, parents from
aggregates, and proofs from joins on (group, place), keys that no hot group makes heavy.  A
level holds half the nodes of the one below it, so all levels together are twice the
leaves, and texts are read once, to be hashed.  Levels are Parquet tables in the shared
folder, so a lost executor costs no level that is written.

Digests are SHA-256 in lowercase hexadecimal; a node is the digest of its children's digests as
text, one after the other; a proof's digest that of the siblings', from the leaf to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault.llm.common import fold, placed
from tallyvault.storage import new_folder, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row's values: `-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _up(nodes: DataFrame, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """The levels over `nodes` (grp, place, digest, size), each with both children's digests, and the one node (grp, digest) that each group ends with.

    A group that has one node stays out of further levels.
    """
    at, levels = 0, []
    below = nodes.select("grp", "place", "digest", "size")
    ends = below.filter("size = 1").select("grp", "digest")
    while True:
        open_ = below.filter("size > 1")
        pairs = open_.groupBy("grp", F.expr("place div 2").alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("digest"))).alias("left"), F.max(F.when(F.col("place") % 2 == 1, F.col("digest"))).alias("right"), F.max(F.expr("(size + 1) div 2")).alias("size")
        )
        level = written(pairs.withColumn("digest", F.sha2(F.concat("left", F.coalesce("right", F.lit(""))), 256)), f"{folder}/level={at}")
        if level.isEmpty():
            return ends, levels
        levels.append(level)
        ends = ends.unionByName(level.filter("size = 1").select("grp", "digest"))
        below, at = level, at + 1


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, place, left, right, proof) of the parents of the lowest level; `tops` (grp, proof) has what each group's own root inherits.

    A proof is the siblings' digests, 32 bytes each, from the node up.
    """
    above: DataFrame | None = None
    for level in reversed(levels):
        own = level.select("grp", "place", "left", "right", "size")
        # a group joins at the level that has its one node
        first = own.filter("size = 1").join(tops, "grp").select("grp", "place", "left", "right", "proof")
        if above is not None:
            pushed = _pushed(own.filter("size > 1").withColumnsRenamed({"left": "l", "right": "r"}), above)
            first = first.unionByName(pushed.select("grp", "place", F.col("l").alias("left"), F.col("r").alias("right"), "proof"))
        above = first
    assert above is not None
    return above


def _pushed(children: DataFrame, parents: DataFrame) -> DataFrame:
    """`children` (grp, place, ...) with their proofs, from their parents'."""
    up = parents.withColumnRenamed("place", "parent")
    sibling = F.when(F.col("place") % 2 == 1, F.col("left")).otherwise(F.col("right"))
    joined = children.withColumn("parent", F.expr("place div 2")).join(up, ["grp", "parent"])
    return joined.withColumn("proof", F.concat(F.coalesce(F.unhex(sibling), F.lit(b"")), F.col("proof"))).drop("parent", "left", "right")


def _folded(start: Column, place: Column, size: Column, proof: Column, skipped: Column, levels: int) -> Column:
    """The digest that a node and its siblings give, over as many levels as its group has; `skipped` siblings of the proof lie below them.

    A node with an odd place has its sibling on the left, another one on the right, unless it is the last.
    """
    out = F.struct(start.alias("digest"), place.alias("place"), size.alias("size"), skipped.cast("long").alias("used"))
    for_level = F.sequence(F.lit(1), F.lit(max(1, levels)))

    def step(now: Column, _: Column) -> Column:
        odd, alone = now["place"] % 2 == 1, (now["place"] % 2 == 0) & (now["place"] + 1 >= now["size"])
        sibling = F.lower(F.hex(F.substring(proof, (now["used"] * 32 + 1).cast("int"), F.lit(32))))
        both = F.when(alone, now["digest"]).when(odd, F.concat(sibling, now["digest"])).otherwise(F.concat(now["digest"], sibling))
        over = now["size"] <= 1
        return F.struct(
            F.when(over, now["digest"]).otherwise(F.sha2(both, 256)).alias("digest"), F.shiftright(now["place"], 1).alias("place"),
            F.shiftright(now["size"] + 1, 1).alias("size"), F.when(over | alone, now["used"]).otherwise(now["used"] + 1).alias("used"),
        )

    return F.aggregate(for_level, out, step)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row a row of `docs`: doc_id (the key), leaf, subroot, root, proof (bytes), folded_root.

    folded_root is what the leaf and its proof give; with `tampered`, new values of some
    columns, it is that of the leaf they give, while all else stays as the true rows have it.
    Leaves of a group ascend by key, null first, then by digest, so rows of one key have
    defined places, and repeated rows equal leaves at places of their own.  A null group is a
    group, the first.  A null value is not an empty one.  Columns that are not named do not
    count.  An empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "merkle")
    # the group as text that is never null and sorts as it does, null first
    grp = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("grp")
    true = leaf([F.col(c) for c in columns])
    false = leaf([tampered.get(c, F.col(c)) for c in columns]) if tampered else true
    # of a true leaf no second copy is kept
    rows = written(docs.select(grp, F.col(key).alias("key"), true.alias("digest"), F.nullif(false, true).alias("false")), f"{folder}/leaves")
    leaves = written(placed(rows, "grp", ["key", "digest"]).withColumnsRenamed({"__tv_place": "place", "__tv_size": "size"}), f"{folder}/placed")
    subroots, levels = _up(leaves, f"{folder}/groups")
    tops = placed(written(subroots.select(F.lit("").alias("all"), "grp", "digest"), f"{folder}/subroots"), "all", ["grp"])
    tops = written(tops.select(F.col("all").alias("grp"), F.col("grp").alias("name"), F.col("__tv_place").alias("place"), "digest", F.col("__tv_size").alias("size")), f"{folder}/tops")
    roots, top_levels = _up(tops, f"{folder}/all")
    none = F.lit(b"")
    proven = tops.select("grp", "place", "name", "size", "digest", none.alias("proof"))
    if top_levels:
        proven = _pushed(tops, _down(top_levels, roots.select("grp", none.alias("proof"))))
    root = roots.select(F.col("digest").alias("root"))
    named = written(proven.select(F.col("name").alias("grp"), F.col("place").alias("top_place"), F.col("size").alias("tops"), F.col("digest").alias("subroot"), "proof").join(F.broadcast(root)), f"{folder}/named")
    alone = leaves.filter("size = 1").join(named.select("grp", "proof"), "grp")
    proofs = alone if not levels else _pushed(leaves.filter("size > 1"), _down(levels, named.select("grp", "proof"))).unionByName(alone)
    whole = proofs.join(F.broadcast(named.drop("proof")) if named.count() <= 10_000 else named.drop("proof"), "grp")
    start = F.coalesce("false", "digest")
    within = _folded(start, F.col("place"), F.col("size"), F.col("proof"), F.lit(0), len(levels))
    folded = whole.withColumn("within", within)
    over = _folded(F.col("within.digest"), F.col("top_place"), F.col("tops"), F.col("proof"), F.col("within.used"), len(top_levels))
    return folded.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof", over["digest"].alias("folded_root"))


def digests(docs: DataFrame) -> DataFrame:
    """The manifest of `documents`, where the rows whose id's checksum 7 divides are told with one character more than they have."""
    more = F.when(fold(F.col("doc_id"), TAMPERED) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = manifest(docs, tampered={"n_chars": more})
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
