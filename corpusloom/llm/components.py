"""Consolidating pairwise matches into groups: connected components.

The links of a match table form mostly stars, trees and long chains with a
small dense remainder.  ``connected_groups`` therefore

1. strips every vertex of degree one and notes the neighbour it hung on,
2. compresses each chain of degree-two vertices: every chain vertex that is no
   local minimum points to its smaller neighbour, and list ranking (pointer
   doubling) takes it to the vertex where its run ends,
3. repeats both while they remove a fair share of the vertices,
4. solves the reduced core by hooking every vertex to its smallest neighbour,
   doubling pointers and contracting, until no link is left,
5. restores the labels of the removed vertices, last removed first.

A pointer always goes to a smaller id (or, for a leaf, to its only neighbour),
so it can't run in a circle.  Every step is a join or an aggregation with
partial aggregates; no group, chain or component is gathered in one task or on
the driver, which sees only row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut, drop

#: While a round of stripping and compressing leaves less than this share of
#: the links, another one follows; then the core is solved.
WORTHWHILE = 0.7
#: Rows up to which a side of a join may be sent to all tasks.
SMALL = 20_000


def links(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected links ``u < v``, each once; nulls and self links drop out."""
    return (
        pairs.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") < F.col("v")))
        .distinct()
        if a != "u" or b != "v"
        else pairs.where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"))
        .distinct()
    )


def _degrees(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("d"))
    return both.groupBy(F.col("d.x").alias("x")).agg(F.count("*").alias("degree"), F.min("d.y").alias("low"))


def _leaves(e: DataFrame, rows: int) -> DataFrame:
    """(child, parent) for each vertex of degree one; of a lone pair only the
    larger one is a child."""
    leaf = _degrees(e).where("degree = 1").select(F.col("x").alias("child"), F.col("low").alias("parent"))
    mate = _side(leaf.select(F.col("child").alias("m")), rows)
    return leaf.join(mate, leaf.parent == mate.m, "left").where("m is null or child > parent").select("child", "parent")


def _side(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join: sent to all tasks only if it has few rows, which the size of
    its file, written compressed, doesn't tell."""
    return df.hint("merge") if rows > SMALL else df


def _without(e: DataFrame, gone: DataFrame, rows: int) -> DataFrame:
    ids = _side(gone.select(F.col("child").alias("g")), rows)
    return e.join(ids, F.col("u") == F.col("g"), "left_anti").join(ids, F.col("v") == F.col("g"), "left_anti")


def _hooks(e: DataFrame, chains_only: bool) -> DataFrame:
    """(child, parent) towards the smallest neighbour, for vertices that aren't
    local minima; with ``chains_only`` for those of degree two."""
    d = _degrees(e).where(F.col("low") < F.col("x"))
    return (d.where("degree = 2") if chains_only else d).select(F.col("x").alias("child"), F.col("low").alias("parent"))


def _ranked(hooks: DataFrame, tag: str, rows: int) -> DataFrame:
    """List ranking: each child's last ancestor, in a number of rounds that is
    the logarithm of the longest run."""
    cur = cut(hooks, tag)
    while True:
        nxt = _side(cur.select(F.col("child").alias("c2"), F.col("parent").alias("p2")), rows)
        step = cut(
            cur.join(nxt, F.col("parent") == F.col("c2"), "left").select("child", F.coalesce("p2", "parent").alias("parent"), F.col("p2").isNotNull().alias("moved")),
            tag,
        )
        moved = step.where("moved").limit(1).count()
        drop(cur)
        cur = step
        if not moved:
            return cur


def _contracted(e: DataFrame, to: DataFrame, rows: int) -> DataFrame:
    a = _side(to.select(F.col("child").alias("ca"), F.col("parent").alias("pa")), rows)
    b = _side(to.select(F.col("child").alias("cb"), F.col("parent").alias("pb")), rows)
    r = e.join(a, F.col("u") == F.col("ca"), "left").join(b, F.col("v") == F.col("cb"), "left")
    return links(r.select(F.coalesce("pa", "u").alias("u"), F.coalesce("pb", "v").alias("v")), "u", "v")


def connected_groups(edges: DataFrame) -> DataFrame:
    """(id, group) for every id of ``edges`` (columns ``u``, ``v``): ``group`` is
    the smallest id that can be reached.

    Links may be repeated, reversed, null at an end or lead to themselves; the
    last two link nothing, and an id with only such links has no row.  An empty
    table gives an empty one.
    """
    e = cut(links(edges, "u", "v"), "links")
    first, n = e, e.count()
    most = n
    layers: list[DataFrame] = []
    core_only = False
    while n:
        before = n
        if not core_only:
            gone = cut(_leaves(e, n), "leaves")
            rest = cut(_without(e, gone, n), "rest")
            layers.append(gone)
            if e is not first:
                drop(e)
            e, n = rest, rest.count()
            if not n:
                break
        to = _ranked(_hooks(e, not core_only), "hooks", n)
        rest = cut(_contracted(e, to, n), "rest")
        layers.append(to)
        if e is not first:
            drop(e)
        e, n = rest, rest.count()
        core_only = core_only or n > before * WORTHWHILE
    ids = first.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    # From the last layer back: a child has the label of its parent.
    label = None
    for layer in reversed(layers):
        if label is None:
            label = layer.select(F.col("child").alias("id"), F.col("parent").alias("root"))
        else:
            up = _side(label.select(F.col("id").alias("i2"), "root"), most)
            here = layer.join(up, F.col("parent") == F.col("i2"), "left").select(F.col("child").alias("id"), F.coalesce("root", "parent").alias("root"))
            label = cut(label.unionByName(here), "label")
    if label is None:
        return ids.select("id", F.col("id").alias("group"))
    rooted = ids.join(_side(label, most), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    low = rooted.groupBy("root").agg(F.min("id").alias("group"))
    return rooted.join(_side(low, most), "root").select("id", "group")


def file_key(c) -> F.Column:
    """A file name as links mean it: no folder, no outer blanks, no case."""
    base = F.regexp_extract(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_replace(base, r"^\s+|\s+$", ""))


def record_links(records: DataFrame) -> DataFrame:
    """Links (u, v) between the ``idx`` of ``records``: by ``duplicate_of``, which
    names the other's ``file_name``, and by an equal positive ``dup_group_id``.

    A group id links in a star around its smallest idx, so a group of n gives
    n - 1 links.  Null or blank names, absent files, a record's own name, null
    ids and group ids that aren't positive link nothing; repeated rows count once.
    """
    r = records.select(F.col("idx").cast("long").alias("idx"), "file_name", "duplicate_of", "dup_group_id").where("idx is not null")
    owner = r.select(file_key(F.col("file_name")).alias("key"), "idx").where("key <> ''").groupBy("key").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    refs = r.select(file_key(F.col("duplicate_of")).alias("key"), "idx").where("key <> ''").distinct()
    named = refs.join(owner, "key")
    direct = named.select(F.col("idx").alias("u"), F.col("first_idx").alias("v"))
    # A name that several idx bear, once referred to, means all of them.
    shared = named.where("first_idx < last_idx").select("key").distinct()
    several = r.select(file_key(F.col("file_name")).alias("key"), "idx").join(shared, "key").join(owner, "key").select(F.col("idx").alias("u"), F.col("first_idx").alias("v"))
    g = r.where("dup_group_id > 0").select("dup_group_id", "idx").distinct()
    hub = g.groupBy("dup_group_id").agg(F.min("idx").alias("hub"))
    star = g.join(hub, "dup_group_id").select(F.col("idx").alias("u"), F.col("hub").alias("v"))
    return direct.unionByName(several).unionByName(star).where("u <> v")


def record_groups(records: DataFrame) -> DataFrame:
    """(idx, group_idx) of each record in a group of two or more."""
    t = records.schema["idx"].dataType
    return connected_groups(record_links(records)).select(F.col("id").cast(t).alias("idx"), F.col("group").cast(t).alias("group_idx"))
