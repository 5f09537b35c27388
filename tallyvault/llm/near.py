"""Near-duplicate documents: an n-gram Jaccard join.

Method: MinHash banding.  A document is the set of its hashed `WORDS`-word shingles.
Band and row counts are chosen for the target recall at the threshold.  Documents that
share a band's hash meet in a bucket; their signatures must then agree well enough
(`ESTIMATE`, five standard errors under the threshold) for a tie, and the documents of
each group so tied are verified against each other on their full shingle sets.

Skew: documents of equal sets are one class, so exact copies meet as one row.  Texts are
found again by id and hash, shingled once, and only their shingles' hashes go to tiles.  Buckets
and groups are dealt into tiles of bounded size.  Only ids and counts leave a tile, never
its pairs: a group of near copies yields a row a member and tile.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.llm.common import bounded, settle
from tallyvault.llm.graph import by_group, components, roots, tiled
from tallyvault.storage import new_folder, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 256
#: Members of a block of a bucket (compared by signature) and of a group (compared by shingle sets).
BUCKET_BLOCK = 4096
GROUP_BLOCK = 384
COLUMNS = 8192
#: A set that so small a share of all rows have is joined to them by broadcast.
HOT_SHARE = 1_000
_WORD = re.compile(r"\w+")
_MASK = (1 << 64) - 1


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows a band): as many rows as the recall at the threshold allows with so many hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams.

    Words are runs of letters, digits and underscores, in lower case; a text without any
    is split at white space.  A text of fewer than `words` words is one n-gram of them
    all.  A text of none has none.
    """
    lower = (text or "").lower()
    found = _WORD.findall(lower) or lower.split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in found], np.uint64)
    n = max(1, len(hashed) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(hashed))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n]
    return np.unique(_mixed(out))


class Hasher:
    """MinHash signatures of many sets at once."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        dice = np.random.default_rng(20_240_901)
        self.a = dice.integers(1, _MASK, bands * rows, np.uint64) | np.uint64(1)
        self.b = dice.integers(0, _MASK, bands * rows, np.uint64)
        self.salt = _mixed(np.arange(1, bands + 1).astype(np.uint64))

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row a (non-empty) set: 32-bit minima."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        first = 0
        while first < len(sets):
            last, size = first, 0
            while last < len(sets) and (size < 1 << 16 or last == first):
                size += len(sets[last])
                last += 1
            flat = np.concatenate(sets[first:last])
            starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first : last - 1]]))).astype(np.int64)
            work = np.empty_like(flat)
            for k in range(len(self.a)):
                np.multiply(flat, self.a[k], out=work)
                np.add(work, self.b[k], out=work)
                out[first:last, k] = (np.minimum.reduceat(work, starts) >> np.uint64(32)).astype(np.uint32)
            first = last
        return out

    def buckets(self, minima: np.ndarray) -> np.ndarray:
        cells = minima.reshape(len(minima), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(self.salt, cells.shape[:2]).copy()
        for r in range(self.rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r])
        return key.astype(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, node (of the shingle set), buckets, signature (a byte a hash); the last three null without an id or words.

    Nodes are 64-bit hashes of whole sets: n different sets share one with a chance of n * n / 2**65.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(bands, rows)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.iloc[at : at + 1000].reset_index(drop=True)
                sets = [shingles(t if isinstance(t, str) else None, words) for t in batch["text"]]
                some = np.flatnonzero([len(s) > 0 and ok for s, ok in zip(sets, batch["doc_id"].notna(), strict=True)])
                out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "node": pd.Series(pd.NA, batch.index, "Int64"), "buckets": None, "signature": None})
                if len(some):
                    sets = [sets[i] for i in some]
                    minima = hasher.minima(sets)
                    out.loc[some, "node"] = [node(s) for s in sets]
                    out.loc[some, "buckets"] = pd.Series(list(hasher.buckets(minima)), some)
                    out.loc[some, "signature"] = pd.Series([m.tobytes() for m in (minima & 255).astype(np.uint8)], some)
                yield out

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return texts.mapInPandas(run, "doc_id long, text_hash long, node long, buckets array<long>, signature binary")


def shingled(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its sorted shingles (8 bytes each), once, of each `wanted` set (rep, text_hash, node), from the text of that id and hash."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 250):  # so few, as shingles take more room than their texts
                batch = whole.iloc[at : at + 250]
                sets = [shingles(t, words) for t in batch["text"]]
                # texts of one id and hash are one text but for a chance of 2**-64
                same = [node(s) == n for n, s in zip(batch["node"], sets, strict=True)]
                yield pd.DataFrame({"node": batch["node"][same], "shingles": [s.tobytes() for s, ok in zip(sets, same, strict=True) if ok]})

    made = texts.join(wanted, ["rep", "text_hash"]).select("node", "text").mapInPandas(run, "node long, shingles binary")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))  # of repeated rows one


def node(shingle_set: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingle_set.tobytes())).astype(np.int64))


def tie(signature: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the rows whose signatures agree in at least `least` of their bytes.

    Breadth first: a row is compared only with rows not yet reached, so a group whose
    members are all alike costs one comparison a member.
    """
    a, b, open_ = [], [], np.arange(len(signature))
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            at = front.pop()
            same = (signature[open_] == signature[at]).mean(1) >= least
            hit = open_[same]
            a += [at] * len(hit)
            b += hit.tolist()
            front += hit.tolist()
            open_ = open_[~same]
    return np.array(a, np.int64), np.array(b, np.int64)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each set of `left` and each of `right` (indexes) are alike, as a matrix."""
    own = np.unique(np.concatenate([left, right]))
    place = np.zeros(len(sets), np.int64)
    place[own] = np.arange(len(own))
    flat = np.concatenate([sets[i] for i in own])
    owner = np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        grid = np.zeros((len(own), min(COLUMNS, int(column[-1]) + 1 - begin)), np.float32)
        grid[owner[a:b], column[a:b] - begin] = 1
        common += grid[place[left]] @ grid[place[right]].T
    n = np.array([len(s) for s in sets], np.float64)
    return common >= threshold * (n[left][:, None] + n[right][None, :] - common) - 1e-6


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """doc_id, text_hash, class_id, links, copies and class_key: one row for each row of `docs`.

    Two documents are linked if their shingle sets have a Jaccard similarity of at least
    `threshold`.  class_id is the least doc_id that links lead to, links the number of
    other rows linked directly, copies the number of rows with exactly its set, itself
    included; text_hash is xxhash64 of the text, and class_key tells classes apart even where
    strangers share a doc_id.  A text without words (null or empty
    too) is linked to nothing and is its own class.  Rows that share a doc_id are copies,
    near copies or strangers by their texts, like any others.  A row whose doc_id is null
    has no name to be linked by: its class_id is null.  Other columns of `docs` are
    ignored.  An empty table gives an empty result.
    """
    bands, rows = banding(threshold, recall, hashes)
    estimate = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (bands * rows))
    signed = settle(signatures(docs, words, bands, rows).withColumn("_row", F.monotonically_increasing_id()))
    sets = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.min("_row").alias("_row"), F.count("*").alias("copies"))
    sets = settle(sets.select("node", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("text_hash"), "_row", "copies"))

    # buckets of at least two sets; of buckets with the same members one is enough
    kept = settle(signed.join(sets.select("_row"), "_row", "left_semi").select("node", "buckets", "signature"))
    cells = kept.select(F.explode(F.array_distinct("buckets")).alias("bucket"), "node")
    full = cells.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("y")).filter("size > 1")
    full = settle(full.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size"))
    met = cells.join(full, "bucket").join(kept.select("node", "signature"), "node")

    def tied(group: pd.DataFrame) -> pd.DataFrame | None:
        bytes_ = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
        a, b = tie(bytes_, estimate)
        nodes = group["node"].to_numpy()
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    edges = by_group(tiled(met, "bucket", "node", "size", BUCKET_BLOCK), ["bucket", "_i", "_j"], tied, "a long, b long").distinct()
    groups = components(edges)

    # verification on full sets, within each group
    sized = groups.join(groups.groupBy("label").agg(F.count("*").alias("size")), "label")
    wanted = settle(sized.join(sets.select("node", "rep", "text_hash", "copies"), "node"))
    arrays = written(shingled(docs, bounded(wanted.select("rep", "text_hash", "node")), words), f"{new_folder(docs.sparkSession, 'shingles')}")
    bodies = wanted.join(arrays, "node")

    def verified(group: pd.DataFrame) -> pd.DataFrame | None:
        found = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
        block, nodes, copies, size = (group[k].to_numpy() for k in ("_block", "node", "copies", "size"))
        i, j = group["_i"].iloc[0], group["_j"].iloc[0]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return None
        alike = linked(found, left, right, threshold)
        if i == j:
            np.fill_diagonal(alike, False)
        a, b = np.nonzero(alike)
        root = nodes[roots(len(nodes), left[a], right[b])]
        n = np.zeros(len(nodes), np.int64)
        np.add.at(n, left, alike @ copies[right])
        if i != j:
            np.add.at(n, right, alike.T @ copies[left])
        return pd.DataFrame({"node": nodes, "root": root, "links": n, "alone": size <= GROUP_BLOCK})

    tiles = settle(by_group(tiled(bodies, "label", "node", "size", GROUP_BLOCK), ["label", "_i", "_j"], verified, "node long, root long, links long, alone boolean"))
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(F.col("alone"), F.col("root"))).alias("label"))
    across = tiles.filter("not alone and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not across.isEmpty():
        far = components(across).withColumnRenamed("label", "far")
        links = links.join(far, "node", "left").select("node", "links", F.coalesce("label", "far").alias("label"))
    links = settle(sets.join(links, "node").select("node", "rep", "links", F.coalesce("label", "node").alias("label")))
    named = links.join(links.groupBy("label").agg(F.min("rep").alias("class_id")), "label").select("node", "class_id", "links", F.col("label").alias("class_key"))
    classes = sets.join(named, "node", "left").select(
        "node", "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("class_key", "node").alias("class_key")
    )
    shown = ("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"), "class_key")
    return spread(signed.select("doc_id", "text_hash", "node"), settle(classes)).select(*shown)


def spread(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """`rows` with the columns of their `node` in `classes`, none where it is null.

    Nodes of a HOT_SHAREth of all rows and more, HOT_SHARE at most, are broadcast, so that
    no task of the shuffled join holds the rows of one of them, nor those without a node.
    """
    least = max(2, (classes.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(classes.filter(F.col("copies") >= least))
    told = rows.join(hot.withColumn("_hot", F.lit(True)), "node", "left")
    columns = [c for c in classes.columns if c != "node"]
    done = told.filter("_hot or node is null").select(*rows.columns, *columns)
    rest = told.filter("_hot is null and node is not null").select(*rows.columns).join(classes.filter(F.col("copies") < least), "node", "left")
    return done.unionByName(rest.select(*rows.columns, *columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class: the one with the least doc_id, of several such rows the one with the least hash of its text.

    Rows whose doc_id is null and texts without words stay.  All columns stay.
    """
    found = settle(near_duplicates(docs).filter("doc_id is not null"))
    named = found.filter("doc_id = class_id and class_key is not null")
    first = named.groupBy("doc_id", "class_key").agg(F.min("text_hash").alias("__tv_first"), F.count("*").alias("__tv_rows")).filter("__tv_rows > 1")
    gone = found.filter("doc_id <> class_id").select("doc_id", "text_hash")
    gone = gone.unionByName(named.join(first, ["doc_id", "class_key"]).filter("text_hash <> __tv_first").select("doc_id", "text_hash"))
    gone = settle(gone.select(F.col("doc_id").alias("__tv_gone"), F.col("text_hash").alias("__tv_hash")).distinct())
    hashed = docs.withColumn("__tv_text", F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(bounded(gone), (F.col("doc_id") == F.col("__tv_gone")) & (F.col("__tv_text") == F.col("__tv_hash")), "left_anti")
    again = settle(found.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("__tv_again"), F.col("text_hash").alias("__tv_hash")))
    same = (F.col("doc_id") == F.col("__tv_again")) & (F.col("__tv_text") == F.col("__tv_hash"))
    if not again.isEmpty():
        once = kept.join(bounded(again), same, "left_semi").dropDuplicates(["doc_id", "__tv_text"])
        kept = kept.join(bounded(again), same, "left_anti").unionByName(once)
    return kept.drop("__tv_text")
