"""Similarity join of documents on their sets of word n-grams, as a grouped prefix join.

Every set is put in one order for the whole corpus: shingles that are not known to be frequent by
hash, then the frequent ones, rarest first. Two sets of Jaccard similarity t or more share a token
within their first n - ceil(t n) + 1. Documents of equal sets become one class, classes of one
prefix and size become one group, and groups meet on prefix tokens. Pairs of groups are filtered by size,
by how many tokens that no other group holds lie ahead of a shared one, and by how many prefix tokens they share and where; of a pair
that is left the leaders are verified on whole sets of 64-bit shingle hashes, and the members with the leader of their group. Members of a pair
whose components differ yet are compared in blocks, as below; no product of members is written.

A token that more than SMALL groups hold is not expanded into pairs at first: its leader, the set with the
fewest tokens of its own, meets the other groups, as a group's leader meets its members, and links so found are
joined into components. Sets that then share a bucket with another component, and have not too many tokens of
their own ahead of the shared one for any partner there, are gathered into families that such buckets connect; a family is cut into blocks of
BLOCK sets, every two blocks meet in a task of their own, and a task passes on a spanning forest of its links. A pair within one component can link nothing new, so no component is lost. The
frequent shingles only order tokens: results do not depend on them.

Defined results: null text or no words, an empty set that links with nothing; fewer words than k, one
shingle of them all; rows that share an id are one document with the links of each; rows without
id are never linked (component_id null); an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, written
from .textkit import U, Words, give_back, lean, mix, slices

#: Of a set's hashes, the lowest share in which prefixes end, and of those one in SAMPLED, picked for each
#: document anew, are counted to find frequent shingles.
LOWEST, SAMPLED = 0.3, 8
#: Occurrences among the counted from which a shingle is ordered as frequent.
FREQUENT = 4
#: The most frequent shingles that the order knows: 16 MB, sent to every task.
MOST_FREQUENT = 1_000_000
#: Groups up to which a token's groups meet in pairs at once.
SMALL = 64
#: Sets of a family that one block holds.
BLOCK = 500
#: Ids up to which a set of ids is broadcast.
BROADCAST_IDS = 1_000_000


def _sets(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    words = Words(batch.column("text"), lower=True)
    flat, off = words.windows(k), words.off.tolist()
    for row, (a, b) in enumerate(zip(off, off[1:])):
        if b - a >= k:
            s = np.sort(flat[a : b - k + 1])
            yield row, s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            yield row, np.array([words.whole(a, b)] if b > a else [], U)


def _needed(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def _frequent(texts: DataFrame, k: int) -> np.ndarray:
    """Frequent shingles, rarest first; at most MOST_FREQUENT."""

    def lowest(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys = part.column("id").to_pylist()
                got = []
                for row, s in _sets(part, k):
                    low = s[: int(LOWEST * len(s)) + 1]
                    got.append(low[mix(low + U((keys[row] or 0) * 0x9E3779B97F4A7C15 % 2**64)) % U(SAMPLED) == 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["token"])

    counted = texts.mapInArrow(lean(lowest), "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    return top["token"].to_numpy(np.int64)[::-1].copy().view(U)


def _prefixes(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, s1, s2, p1, late, prefix) of each row: size, two signatures of the set, one of the prefix,
    where its frequent tokens begin, and the prefix."""
    frequent = _frequent(texts, k)
    by_hash = np.argsort(frequent)
    sent = texts.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash))
    del frequent, by_hash
    give_back()

    def rows(batches):
        keys, rank = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, s1, s2, p1, late_from, prefix = [], [], [], [], [], []
                for _, s in _sets(part, k):
                    length = len(s) - _needed(len(s), percent) + 1 if len(s) else 0
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        known = keys[at] == s
                        first = s[~known][:length]
                        early = len(first)
                        if early < length:
                            late = s[known][np.argsort(rank[at[known]], kind="stable")]
                            first = np.concatenate([first, late[: length - early]])
                    else:
                        first, early = s[:length], length
                    late_from.append(early)
                    n.append(len(s))
                    s1.append(mix(s).sum(dtype=U))
                    s2.append(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U))
                    p1.append(mix(mix(first) + np.arange(len(first), dtype=U)).sum(dtype=U))
                    prefix.append(first.view(np.int64))
                off = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
                signs = [pa.array(np.array(x, U).view(np.int64)) for x in (s1, s2, p1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int32()), *signs, pa.array(late_from, pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(prefix)))],
                    ["id", "n", "s1", "s2", "p1", "late", "prefix"],
                )

    return texts.mapInArrow(lean(rows), "id long, n int, s1 long, s2 long, p1 long, late int, prefix array<long>")


def _shingle_sets(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, tokens) of the rows whose id is among ids."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for _, s in _sets(part, k)]
                off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "tokens"])

    ids = written(ids.distinct(), "ids")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return written(texts.join(some, "id", "left_semi").mapInArrow(lean(rows), "id long, tokens array<long>"), "sets")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    pairs = written(pairs.distinct(), "pairs")
    sets = _shingle_sets(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), k)

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    similar = both.where(100 * shared >= percent * (F.size("ta") + F.size("tb") - shared)).where(shared > 0)
    return written(similar.select("a", "b"), "links")


def _counted_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb), a < b, of different components in one bucket whose sets, of sizes na and nb, may be similar enough.

    entries: (token, id, n, pos, comp, ahead, other); ahead is how many tokens before pos no other group's prefix
    holds, other how many are in buckets left out here. Both prefixes reach the shared token, so that those ahead
    of it are not shared; those behind it can be in the rest of a set whose prefix ends earlier.
    Tokens up to the last one shared are all counted; beyond it no more than the rest of either set can be
    shared, and beyond the end of the prefix that ends first no more than the rest of that set.
    """
    one = entries.select("token", *[F.col(c).alias(f"{c}a") for c in ("id", "n", "pos", "comp", "ahead", "other")])
    two = entries.select("token", *[F.col(c).alias(f"{c}b") for c in ("id", "n", "pos", "comp", "ahead", "other")])
    met = one.join(two, "token").where("ida < idb AND compa <> compb").where(f"na * 100 >= nb * {percent} AND nb * 100 >= na * {percent}")
    met = met.where(f"least(na - aheada, nb - aheadb) * {100 + percent} >= {percent} * (na + nb)")
    met = met.groupBy("ida", "idb", "na", "nb", "othera", "otherb").agg(F.count("*").alias("c"), F.max("posa").alias("pa"), F.max("posb").alias("pb"))
    shared = F.col("c") + F.least("othera", "otherb")
    past_last = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    past_prefix = F.greatest(*[F.ceil(F.col(n) * percent / 100) - 1 for n in ("na", "nb")])
    possible = (shared + F.least(past_last, past_prefix)) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    return met.where(possible).select(F.col("ida").alias("a"), F.col("idb").alias("b"), "na", "nb")


def _leader_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each bucket's leader, with the fewest tokens of its own, and its other members of near size, as (a, b), a < b."""
    rank = F.struct("own", F.xxhash64("id").alias("h"), "id", "n", "comp")
    leader = entries.groupBy("token").agg(F.min(rank).alias("l"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    met = entries.join(leader.select("token", "l"), "token").where("comp <> l.comp").where(f"n * 100 >= l.n * {percent} AND l.n * 100 >= n * {percent}")
    return met.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b"))


def _mixed(entries: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """entries, with the components that links make, of buckets that hold several, but those that can link to no set of their bucket."""
    label = written(components(links), "labels").withColumnRenamed("node", "id")
    now = entries.drop("comp").join(label, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    least = now.groupBy("token").agg(F.min("n").alias("least_n"))
    partner = F.greatest("least_n", F.ceil(F.col("n") * percent / 100))
    now = now.join(least, "token").where((F.col("n") - F.col("ahead")) * (100 + percent) >= percent * (F.col("n") + partner)).drop("least_n")
    mixed = now.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    return written(now.join(mixed, "token", "left_semi"), "entries")


def _forest(part: pa.Table, percent: int) -> pa.Table:
    """(a, b): each set of two blocks with the smallest that its links there reach, where that is another."""
    ids, lists = part["id"].to_numpy(), part["tokens"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    _, token, held = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), size)
    common = held > 1
    rank = np.cumsum(common) - 1
    row, col = row[common[token]], rank[token[common[token]]]
    shared = np.zeros((len(ids), len(ids)), np.float32)
    step = max(1, 16_000_000 // max(1, len(ids)))
    for first in range(0, int(common.sum()), step):
        at = (col >= first) & (col < first + step)
        m = np.zeros((len(ids), min(step, int(common.sum()) - first)), np.float32)
        m[row[at], col[at] - first] = 1
        shared += m @ m.T
    near = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (shared > 0)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(ids)).min(1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    other = root != np.arange(len(ids))
    del shared, near, row, col, token
    give_back()
    return pa.table({"a": ids[other], "b": ids[root][other]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _dense_links(entries: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among the sets of entries (token, id), as forests of block pairs of families that tokens connect."""
    lead = entries.groupBy("token").agg(F.min("id").alias("lead"))
    family = components(entries.join(lead, "token").select(F.col("id").alias("a"), F.col("lead").alias("b")))
    family = written(family.withColumnRenamed("node", "id").withColumnRenamed("component", "family"), "families")
    blocks = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = _shingle_sets(texts, family.select("id"), k)
    each = family.join(blocks, "family").join(sets, "id").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), "blocks").cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "tokens")
    return written(each.groupBy("family", "i", "j").applyInArrow(lambda part: _forest(part, percent), "a long, b long"), "links")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id), a row for each row of docs.

    Two documents link when 100 * shared shingles >= percent * shingles of either; component_id is the
    smallest id that links reach.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(_prefixes(texts, k, percent), "prefixes")

    # equal sets are one class; its smallest id stands for it
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.first("p1").alias("p1"), F.first("late").alias("late"), F.first("prefix").alias("prefix"))
    classes = written(classes, "classes")
    same = rows.where("n > 0 AND id IS NOT NULL").select("id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"])
    same = same.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # one prefix and size is one group; members are its classes
    groups = classes.groupBy("n", "p1").agg(F.min("rep").alias("gid"), F.first("late").alias("late"), F.first("prefix").alias("prefix"), F.count("*").alias("members"))
    members = classes.select("n", "p1", "rep").join(groups.where("members > 1").select("n", "p1", "gid"), ["n", "p1"]).select("gid", "rep", "n")
    members = written(members, "members")
    each = groups.select("gid", "n", "late", F.posexplode("prefix").alias("pos", "token"))
    each = each.select("token", F.col("gid").alias("id"), "n", "pos", (F.col("pos") >= F.col("late")).alias("often"))
    # a token that few sets hold is counted where its rows meet; a frequent one is counted apart and
    # joined, so that its rows can be split
    few = each.where("NOT often").withColumn("met", F.count("*").over(Window.partitionBy("token"))).where("met > 1").drop("often")
    often = each.where("often").drop("often")
    often = often.join(often.groupBy("token").agg(F.count("*").alias("met")).where("met > 1"), "token").select(*few.columns)
    entries = written(few.union(often), "entries")
    of_id = Window.partitionBy("id").orderBy("pos")
    whole = of_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = lambda inside: F.count(F.when(inside, 1)).over(whole)
    entries = entries.select("*", (F.col("pos") + 1 - F.row_number().over(of_id)).alias("ahead"), held(F.col("met") <= SMALL).alias("in_small"), held(F.col("met") > SMALL).alias("in_large"))
    prefix_size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    entries = entries.withColumn("own", prefix_size - F.col("in_small") - F.col("in_large")).withColumn("comp", F.col("id"))

    def verified(pairs: DataFrame) -> DataFrame:
        return _linked(pairs, texts, k, percent)

    # groups of small buckets in pairs: leader with leader, and all their members as a bucket of their own
    small = written(_counted_pairs(entries.where(F.col("met") <= SMALL).withColumn("other", F.col("in_large")), percent), "group-pairs")
    zero = F.lit(0).cast("long")
    bucket = lambda df, token: df.select(token.alias("token"), F.col("rep").alias("id"), "n", F.lit(0).alias("pos"), zero.alias("own"), zero.cast("int").alias("ahead"), zero.alias("other"), F.col("rep").alias("comp"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("na").alias("n")), F.struct(F.col("b").alias("gid"), F.col("nb").alias("n"))))
    sides = small.select(F.xxhash64("a", "b", F.lit("pair")).alias("token"), sides.alias("s")).select("token", "s.gid", "s.n")
    sides = sides.join(members.select("gid", "rep"), "gid", "left")
    paired = sides.join(sides.where("rep IS NOT NULL").select("token").distinct(), "token", "left_semi").withColumn("rep", F.coalesce("rep", "gid"))
    # groups of large buckets by their leaders, members by the leader of their group
    large = entries.where(F.col("met") > SMALL).withColumn("other", F.col("in_small")).join(members.select(F.col("gid").alias("id"), "rep"), "id", "left")
    large = large.select("token", F.coalesce("rep", "id").alias("id"), "n", "pos", "own", "ahead", "other", F.coalesce("rep", "id").alias("comp"))
    large = large.unionByName(bucket(members, F.xxhash64("gid", F.lit("group"))))
    links = verified(small.select("a", "b").union(_leader_pairs(large, percent)))

    # buckets of several components yet
    links = links.union(_dense_links(_mixed(large.unionByName(bucket(paired, F.col("token"))), links, percent), texts, k, percent))

    label = components(links.union(same))
    out = rows.select("id", "n").join(label.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
