"""Versions of a graph: content ids, commit, diff, union, three-way merge, ancestors, log, blame, revert, refs, reachability.

A snapshot is a DataFrame (id, cid, ...) where cid is the content id of the row, so equal rows have equal cids.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import node_content_id
from ..plans.lineage import cut
from . import history


def with_cid(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("cid", node_content_id(F.col("ntype"), F.col("summary"), F.col("props")))


# --- snapshots ------------------------------------------------------------------------------------------------


def committed(base: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """base less the removed keys, with added rows in place of those of their keys; what is added again is not removed."""
    out = base
    if removed is not None:
        out = out.join(removed.select(key), key, "left_anti")
    if added is not None:
        out = out.join(added.select(key), key, "left_anti").unionByName(added, allowMissingColumns=True)
    return out


def cascaded(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those that begin or end at a removed node."""
    gone = removed.select("id")
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node; a commit must have none."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return out.dropDuplicates(["id"])


def remembered(nodes: DataFrame, now: int) -> DataFrame:
    """Nodes with created_at and updated_at; the caller's values win."""
    return nodes.withColumn("created_at", F.coalesce("created_at", F.lit(now))).withColumn("updated_at", F.coalesce("updated_at", F.lit(now)))


def upserted(base: DataFrame, staged: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the last staged row of each key in place of its own."""
    last = staged.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_rank = 1").drop("_rank", order)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def resolved_or_created(wanted: DataFrame, nodes: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(ntype, prop, value, id, created): the node with that typed value, the last by id among several, or a new id from the content."""
    live = nodes if tombstones is None else nodes.join(tombstones.select(F.col("node_id").alias("id")), "id", "left_anti")
    index = live.select("id", "ntype", F.explode("props").alias("prop", "value")).groupBy("ntype", "prop", "value").agg(F.max("id").alias("found"))
    new = F.concat(F.lit("new:"), F.substring(F.sha2(F.concat_ws("\n", "ntype", "prop", "value"), 256), 1, 32))
    return wanted.join(index, ["ntype", "prop", "value"], "left").select("ntype", "prop", "value", F.coalesce("found", new).alias("id"), F.col("found").isNull().alias("created"))


# --- diff and merge -------------------------------------------------------------------------------------------


def diff(old: DataFrame, new: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, change, old_cid, new_cid): added, removed and changed keys. Keys with equal content take no part beyond the join."""
    a, b = old.select("id", F.col("cid").alias("old_cid")), new.select("id", F.col("cid").alias("new_cid"))
    t = a.join(b, "id", "full_outer").where(~F.col("old_cid").eqNullSafe(F.col("new_cid")))
    out = t.select("id", F.when(F.col("old_cid").isNull(), "added").when(F.col("new_cid").isNull(), "removed").otherwise("changed").alias("change"), "old_cid", "new_cid")
    return out if limit is None else out.withColumn("_n", F.row_number().over(W.partitionBy("change").orderBy("id"))).where(F.col("_n") <= limit).drop("_n")


def inverse(changes: DataFrame) -> DataFrame:
    """The diff that undoes a diff."""
    return changes.select("id", F.when(F.col("change") == "added", "removed").when(F.col("change") == "removed", "added").otherwise("changed").alias("change"), F.col("new_cid").alias("old_cid"), F.col("old_cid").alias("new_cid"))


def reverted(now: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, cid) of `now` with the changes from `before` to `after` undone; keys changed since stay as they are."""
    back = inverse(diff(before, after))
    t = now.select("id", "cid").join(back, "id", "full_outer")
    untouched = F.col("change").isNull() | ~F.col("cid").eqNullSafe(F.col("old_cid"))
    return t.select("id", F.when(untouched, F.col("cid")).otherwise(F.col("new_cid")).alias("cid")).where("cid is not null")


def union_versions(versions: list[DataFrame]) -> DataFrame:
    """(id, cid, conflict): all keys; where versions differ the greatest cid wins."""
    t = reduce(DataFrame.unionByName, [v.select("id", "cid") for v in versions])
    return t.groupBy("id").agg(F.max("cid").alias("cid"), (F.min("cid") != F.max("cid")).alias("conflict"))


def union_by_strategy(ours: DataFrame, theirs: DataFrame, strategy: str) -> DataFrame:
    """(id, cid): all keys of both; where both have one, `ours`, `theirs` or the `greatest` cid."""
    a, b = ours.select("id", F.col("cid").alias("a")), theirs.select("id", F.col("cid").alias("b"))
    pick = {"ours": F.coalesce("a", "b"), "theirs": F.coalesce("b", "a"), "greatest": F.greatest("a", "b")}[strategy]
    return a.join(b, "id", "full_outer").select("id", pick.alias("cid"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, base_cid, our_cid, their_cid, outcome, cid) of every key any side has.

    outcome: same, ours, theirs, both (changed alike), or a conflict: divergent, or delete-modify. cid is null where the key is gone,
    and for conflicts the greatest cid, which is only a suggestion."""
    t = base.select("id", F.col("cid").alias("base_cid")).join(ours.select("id", F.col("cid").alias("our_cid")), "id", "full_outer").join(theirs.select("id", F.col("cid").alias("their_cid")), "id", "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = (
        F.when(same("our_cid", "their_cid"), F.when(same("our_cid", "base_cid"), "same").otherwise("both")).when(same("their_cid", "base_cid"), "ours").when(same("our_cid", "base_cid"), "theirs")
        .when(F.col("our_cid").isNull() | F.col("their_cid").isNull(), "delete-modify").otherwise("divergent")
    )
    t = t.withColumn("outcome", outcome)
    cid = F.when(F.col("outcome").isin("same", "both", "ours"), F.col("our_cid")).when(F.col("outcome") == "theirs", F.col("their_cid")).otherwise(F.greatest("our_cid", "their_cid"))
    return t.withColumn("cid", cid)


CONFLICTS = ("divergent", "delete-modify")


def settled(merged: DataFrame, strategy: str | None = None, picks: DataFrame | None = None) -> DataFrame:
    """(id, cid) after a merge: picks (id, side) first, then the strategy `ours` or `theirs`, then the suggestion."""
    t = merged if picks is None else merged.join(picks.select("id", "side"), "id", "left")
    side = F.col("side") if picks is not None else F.lit(None).cast("string")
    side = F.coalesce(side, F.lit(strategy))
    cid = F.when(~F.col("outcome").isin(*CONFLICTS), F.col("cid")).when(side == "ours", F.col("our_cid")).when(side == "theirs", F.col("their_cid")).otherwise(F.col("cid"))
    return t.select("id", cid.alias("cid")).where("cid is not null")


def edge_collisions(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(src, dst, etype): edges between the same ends that the sides give other properties."""
    a, b = (x.select("src", "dst", "etype", F.col("cid").alias(n)) for x, n in ((ours, "a"), (theirs, "b")))
    return a.join(b, ["src", "dst", "etype"]).where("a <> b").select("src", "dst", "etype").distinct()


def tombstone_conflicts(merged: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Keys that one side revoked while the content changed."""
    return merged.where(~F.col("outcome").isin("same")).join(tombstones.select(F.col("node_id").alias("id")), "id", "left_semi").select("id", "outcome")


def conflict_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def merged_refs(base: DataFrame, heads: list[DataFrame]) -> DataFrame:
    """(name, targets, kind) by a signed multiset: each head adds its target, the base takes away one less than there are heads."""
    signed = [h.select("name", "target", F.lit(1).alias("sign")) for h in heads] + [base.select("name", "target", F.lit(1 - len(heads)).alias("sign"))]
    left = reduce(DataFrame.unionByName, signed).groupBy("name", "target").agg(F.sum("sign").alias("n")).where("n > 0")
    out = left.groupBy("name").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return out.select("name", F.array_join("targets", ",").alias("targets"), F.when(F.size("targets") > 1, "conflicted").otherwise("normal").alias("kind"))


# --- history --------------------------------------------------------------------------------------------------


#: Histories of up to so many parent links are walked by one task for each head, which holds them all; longer ones as history.py says.
WALK_LINKS = 50_000


def walked(links: list, most: int):
    """For applyInPandas over one head's (head, cid): (head, cid, depth) of all it comes from, breadth first."""
    up: dict = {}
    for cid, parent in links:
        up.setdefault(cid, []).append(parent)

    def one(t: pd.DataFrame) -> pd.DataFrame:
        depth = dict.fromkeys(t["cid"], 0)
        now = list(depth)
        for d in range(1, most):
            now = [c for c in dict.fromkeys(p for c in now for p in up.get(c, ())) if c not in depth]
            if not now:
                break
            depth.update(dict.fromkeys(now, d))
        return pd.DataFrame({"head": t["head"].iat[0], "cid": list(depth), "depth": np.array(list(depth.values()), np.int32)})

    return one


def ancestors(commits: DataFrame, heads: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(head, cid, depth) of everything that the heads (head, cid) come from, themselves at depth 0; depth is the shortest.

    A walk for each head where there are few links; otherwise by clusters along the commits' time (their cid, if they have none)."""
    parents = commits.select("cid", F.explode("parents").alias("parent"))
    if parents.limit(WALK_LINKS + 1).count() <= WALK_LINKS:
        links = parents.collect()
        kinds = {f.name: f.dataType.simpleString() for f in heads.schema.fields}
        return heads.select("head", "cid").groupBy("head").applyInPandas(walked([tuple(x) for x in links], most), f"head {kinds['head']}, cid {kinds['cid']}, depth int")
    return history.reached(commits, heads).where(F.col("depth") < most)


def lowest_common_ancestor(commits: DataFrame, heads: list[str]) -> DataFrame:
    """One row, cid: a common ancestor of all heads that no other common ancestor descends to; the smallest on ties, none if unrelated.

    What a common ancestor comes from is common too, so the lowest ones are those that are no parent of a common ancestor."""
    spark = commits.sparkSession
    reach = cut(ancestors(commits, spark.createDataFrame([(h, h) for h in heads], "head string, cid string")))
    common = cut(reach.groupBy("cid").agg(F.count_distinct("head").alias("n")).where(F.col("n") == len(set(heads))).select("cid"))
    above = commits.join(common, "cid").select(F.explode("parents").alias("cid"))
    return common.join(above, "cid", "left_anti").agg(F.min("cid").alias("cid"))


def log(commits: DataFrame, head: str, limit: int = 20) -> DataFrame:
    """(depth, cid, author, time, message) along first parents; one recursive query."""
    text = """
        WITH RECURSIVE line(depth, cid, author, time, message, parent) AS (
            SELECT 0, cid, author, time, message, try_element_at(parents, 1) FROM {commits} WHERE cid = :head
            UNION ALL
            SELECT depth + 1, c.cid, c.author, c.time, c.message, try_element_at(c.parents, 1)
            FROM line JOIN {commits} c ON c.cid = line.parent WHERE depth + 1 < :most)
        SELECT depth, cid, author, time, message FROM line"""
    return commits.sparkSession.sql(text, args={"head": head, "most": int(limit)}, commits=commits)


def recent_operations(operations: DataFrame, head: str, limit: int = 10) -> DataFrame:
    """(depth, cid, author, time, description) of the last operations along first parents, at most 100."""
    own = operations.select("cid", "parents", "author", "time", F.col("description").alias("message"))
    return log(own, head, min(100, max(1, limit))).withColumnRenamed("message", "description")


def blame(reach: DataFrame, edge_versions: DataFrame) -> DataFrame:
    """(id, cid): for each edge the farthest ancestor (cid, depth) that holds it; the smallest of those on ties."""
    t = edge_versions.select(F.col("commit").alias("cid"), "id").join(reach.select("cid", "depth"), "cid")
    return t.groupBy("id").agg(F.min_by("cid", F.struct((-F.col("depth")).alias("d"), "cid")).alias("cid"))


def at(versions: DataFrame, commit: str) -> DataFrame:
    """Time travel: the rows of one commit; partitioned by commit, only they are read."""
    return versions.where(F.col("commit") == commit).drop("commit")


def unreachable(blocks: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks (cid) that no root (cid) leads to over links (cid, parent)."""
    as_commits = links.groupBy("cid").agg(F.collect_list("parent").alias("parents"))
    if "time" in blocks.columns:
        as_commits = as_commits.join(blocks.groupBy("cid").agg(F.min("time").alias("time")), "cid", "left")
    reach = ancestors(as_commits, roots.select(F.col("cid").alias("head"), "cid"))
    return blocks.select("cid").join(reach.select("cid").distinct(), "cid", "left_anti")


def corrupt(blocks: DataFrame) -> DataFrame:
    """Blocks (cid, content) whose content has another hash."""
    return blocks.where(F.sha2("content", 256) != F.col("cid")).select("cid")


def merged_views(ancestor: DataFrame, heads: list[DataFrame]) -> DataFrame:
    """(kind, name, value) of a view merged from several: what a head adds to the ancestor is in, what a head takes away is out.

    A view's rows are its heads, tombstones and refs; a row that one head took away stays gone, whatever the others say."""
    key = ["kind", "name", "value"]
    every = reduce(DataFrame.unionByName, [h.select(*key) for h in [ancestor, *heads]]).distinct()
    for h in heads:
        gone = ancestor.select(*key).join(h.select(*key), key, "left_anti")
        every = every.join(gone, key, "left_anti")
    return every


def merged_heads(operations: DataFrame, heads: DataFrame) -> DataFrame:
    """One row, (cid, parents, description): the operation that merges several heads (cid), the same whatever their order."""
    parents = heads.join(operations.select("cid"), "cid", "left_semi").agg(F.array_sort(F.collect_set("cid")).alias("parents"))
    merge = F.concat(F.lit("merge:"), F.substring(F.sha2(F.array_join("parents", ","), 256), 1, 32))
    one = F.size("parents") == 1
    return parents.where(F.size("parents") > 0).select(
        F.when(one, F.col("parents")[0]).otherwise(merge).alias("cid"), "parents", F.when(one, "head").otherwise("merge operation heads").alias("description")
    )


def untombstoned(tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones without those of these nodes (id)."""
    return tombstones.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def unpicked(merged: DataFrame, picks: DataFrame) -> DataFrame:
    """Conflicts that no pick (id, side) settles yet: a merge goes on when there are none, and is given up by keeping ours."""
    return merged.where(F.col("outcome").isin(*CONFLICTS)).join(picks.select("id"), "id", "left_anti").select("id", "outcome")


def status(refs: DataFrame, commits: DataFrame, branch: str) -> DataFrame:
    """One row: the branch, its commit, who made it and when, and how many branches and tags there are."""
    head = refs.where(F.col("name") == f"refs/heads/{branch}").select(F.col("target").alias("cid")).join(commits.select("cid", "author", "time"), "cid", "left")
    counts = refs.agg(F.count_if(F.col("name").startswith("refs/heads/")).alias("branches"), F.count_if(F.col("name").startswith("refs/tags/")).alias("tags"))
    return head.limit(1).select(F.lit(branch).alias("branch"), "cid", "author", "time").crossJoin(counts)  # one row each


def block(blocks: DataFrame, cid: str) -> DataFrame:
    """(cid, size, content) of one block."""
    return blocks.where(F.col("cid") == cid).select("cid", F.octet_length("content").cast("long").alias("size"), "content")


def links_in(blocks: DataFrame) -> DataFrame:
    """(cid, link): the content ids that stand in a block's text."""
    return blocks.select("cid", F.explode(F.array_distinct(F.regexp_extract_all(F.col("content").cast("string"), F.lit("([0-9a-f]{64})"), 1))).alias("link"))


#: Bits and hash functions of a have-set: about one cid in a hundred that isn't there seems to be.
HAVE_BITS, HAVE_HASHES = 10, 7


def have_set(cids: DataFrame, bits: int | None = None) -> tuple[DataFrame, int]:
    """((bit), bits): a Bloom filter of the cids, HAVE_BITS bits for each, as the table of its set bits."""
    bits = bits or max(64, HAVE_BITS * cids.count())
    return _bits(cids, bits).select("bit").distinct(), bits


def _bits(cids: DataFrame, bits: int) -> DataFrame:
    hashes = F.array(*[F.pmod(F.xxhash64("cid", F.lit(k)), F.lit(bits)) for k in range(HAVE_HASHES)])
    return cids.select("cid", F.explode(F.array_distinct(hashes)).alias("bit"))


def not_had(cids: DataFrame, have: tuple[DataFrame, int]) -> DataFrame:
    """cids that are surely not in a have-set: one of their bits is unset."""
    table, bits = have
    return _bits(cids, bits).join(table, "bit", "left_anti").select("cid").distinct()


# --- refs -----------------------------------------------------------------------------------------------------


class Stale(RuntimeError):
    pass


def refs_named(refs: DataFrame, prefix: str) -> DataFrame:
    return refs.where(F.col("name").startswith(prefix)).select(F.expr(f"substring(name, {len(prefix) + 1})").alias("name"), "target")


def set_ref(refs: DataFrame, name: str, target: str | None, expected: str | None = "*") -> DataFrame:
    """refs with name at target (None: deleted). expected: what it must point to now, None for nothing, "*" for anything."""
    if expected != "*":
        now = refs.where(F.col("name") == name).select("target").limit(1).collect()
        if (now[0][0] if now else None) != expected:
            raise Stale(f"{name} isn't at {expected}")
    rest = refs.where(F.col("name") != name)
    if target is None:
        return rest
    return rest.unionByName(refs.sparkSession.createDataFrame([(name, target)], "name string, target string"), allowMissingColumns=True)


def resolve_commitish(refs: DataFrame, commits: DataFrame, text: str) -> DataFrame:
    """One row, cid: a branch, a tag, any ref, or a commit by its id, in that order."""
    named = refs.select("target", F.when(F.col("name") == f"refs/heads/{text}", 0).when(F.col("name") == f"refs/tags/{text}", 1).when(F.col("name") == text, 2).alias("kind")).where("kind is not null")
    own = commits.where(F.col("cid") == text).select(F.col("cid").alias("target"), F.lit(3).alias("kind"))
    return named.unionByName(own).agg(F.min_by("target", "kind").alias("cid"))


def revoked(signatures: DataFrame, revocations: DataFrame) -> DataFrame:
    """Signatures (cid, key, time) made after their key (key, revoked_at) was revoked."""
    return signatures.join(revocations, "key").where("time > revoked_at").select("cid", "key", "time")


def live_export(nodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Nodes for an export without what was revoked."""
    return nodes.join(tombstones.select(F.col("node_id").alias("id")), "id", "left_anti")
