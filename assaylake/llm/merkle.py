"""Merkle manifest of a dataset: a tree for each language, and one over the languages' roots.

Leaves are ordered by range partitions, whose counts give each leaf its place, so that a language of any size is ordered by
all tasks. Places are cut into blocks of ``8 ** LEVELS`` leaves. A block is one row with its ordered leaves; sequence,
transform, slice and aggregate collapse it level by level to its root. The roots of the blocks are the leaves of the next
round, until each language has one, and the languages' roots go through the same rounds. On the way back each block gets
the path from its root to the top, a few levels of siblings, and folds every leaf within it: proofs are never rows of
their own, but one digest a leaf.

A level's run is hashed also where it is one node, as long as the tree has more nodes on that level. So a block in a tree
of several blocks always goes up LEVELS levels, and only a tree that is one block stops where one node is left.

Only SQL functions run. Tables between the steps hold digests, not texts: about 100 bytes a document.

Defined cases: nulls are ``-`` in a leaf, a null language is a tree of its own and comes first; a null doc_id comes before
others; rows that repeat a doc_id are in the order of their leaves, equal ones each a leaf; texts of any length are hashed
whole; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import discard, partitions, written

#: Nodes that are hashed together, and levels that a block collapses.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(**fields: Column) -> Column:
    """Digest of the fields in the order given; the length before each value keeps neighbours apart."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields.values()]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the language), key (the doc_id), digest, and the digest after tampering of the rows that are tampered with."""
    f = {c: F.col(c) for c in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = leaf(**(f | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}))
    return docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("key"), leaf(**f).alias("digest"), F.when(hit, other).alias("tampered"), F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, order: list[str], folders: list[str]) -> DataFrame:
    """Rows with their place, from 0, in their tree, by the columns of ``order`` with nulls first, and ``n``, the rows of their tree.

    A range's rows are numbered within its task; the rows of earlier ranges are counted. ``row`` comes last in the order,
    so that equal rows, which may be many, are dealt over ranges too.
    """
    sorts = [F.col(c).asc_nulls_first() for c in ["tree", *order, "row"]]
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), *sorts).sortWithinPartitions(*sorts)
    kept = written(ranges.withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.shiftright("id", 33)), "merkle-order", folders)
    # as many rows as ranges and trees together
    counts = kept.groupBy("range", "tree").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first"))
    before = counts.select(F.col("range").alias("r"), F.col("tree").alias("t"), "first", F.expr("sum(k) over (partition by tree order by range) - k").alias("before"), F.expr("sum(k) over (partition by tree)").alias("n"))
    at = kept.join(before, (F.col("range") == F.col("r")) & F.col("tree").eqNullSafe(F.col("t")))
    return at.withColumn("place", F.col("id") - F.col("first") + F.col("before")).drop("id", "range", "row", "r", "t", "first", "before")


def levels_of(nodes: Column, depth: Column) -> Column:
    """The arrays of nodes from the leaves, level 0, up to level ``depth``."""

    def up(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(level) / ARITY).cast("int") - 1)
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * ARITY + 1, ARITY), ""), 256))

    steps = F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), F.lit(1), depth)
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(up(F.element_at(done, -1)))))


def siblings(levels: Column, place: Column) -> Column:
    """left, right: what stands before and after the node of each level within its run, from the leaf at ``place`` up."""

    def of(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(ARITY), k)).cast("int")
        first = at - at % ARITY
        left, right = F.slice(level, first + 1, at - first), F.slice(level, at + 2, first + ARITY - 1 - at)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), of)


def folded(node: Column, path: Column) -> Column:
    return F.aggregate(path, node, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def blocks(nodes: DataFrame, done: int, folders: list[str]) -> DataFrame:
    """tree, block, nodes (in order of place), n, levels. ``nodes`` has tree, place, n (leaves of the tree), digest and what
    else each carries along; ``done`` levels lie below."""
    carried = [c for c in nodes.columns if c not in ("tree", "place", "n")]
    rows = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", *carried))).alias("nodes"), F.max("n").alias("n"))
    # as many levels as the tree has left; comparisons of whole numbers, as logarithms are not exact
    left = sum((F.when(F.col("n") > ARITY ** (done + k), 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
    return written(rows.withColumn("levels", levels_of(F.transform("nodes", lambda x: x["digest"]), left)), "merkle-blocks", folders)


def top(levels: str = "levels") -> Column:
    return F.element_at(F.element_at(levels, -1), 1)


def rounds(nodes: DataFrame, folders: list[str]) -> list[DataFrame]:
    """The blocks of each round, from the leaves to the round in which every tree is one block."""
    most, out = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        done = LEVELS * len(out)
        out.append(blocks(nodes, done, folders))
        if most <= ARITY ** (done + LEVELS):
            return out
        nodes = out[-1].select("tree", F.col("block").alias("place"), "n", top().alias("digest"))


def with_paths(block: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with what ``above`` (tree, block, path and others) says of their roots: the path to the top."""
    a = above.withColumnsRenamed({"tree": "t", "block": "b"})
    return block.join(a, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")


def descended(up: list[DataFrame], path: DataFrame) -> DataFrame:
    """The blocks of the lowest round with the paths from their roots to the top, where ``path`` has those of the trees' own roots."""
    names = [c for c in path.columns if c not in ("tree", "block", "path")]
    for level in reversed(up[1:]):  # its nodes are the blocks of the round below
        own = F.transform("nodes", lambda x: F.struct(x["place"].alias("block"), full_path(x).alias("path")))
        path = with_paths(level, path).select("tree", *names, F.inline(own))
    return with_paths(up[0], path)


def full_path(node: Column) -> Column:
    return F.concat(siblings(F.col("levels"), node["place"] % BLOCK), F.col("path"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    folders: list[str] = []
    rows = written(leaves(docs), "merkle-leaves", folders)
    up = rounds(written(placed(rows, ["key", "digest"], folders), "merkle-places", folders), folders)

    # the trees' roots are the leaves of a tree on top, ordered by language
    one = F.lit(0).cast("long")
    tops = written(up[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), top().alias("digest"), one.alias("row")), "merkle-subroots", folders)
    over = rounds(written(placed(tops, ["lang"], folders), "merkle-places", folders), folders)
    root = (over[-1].select(top().alias("root")).first() or [None])[0]
    none = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    heads = descended(over, over[-1].select("tree", one.alias("block"), none))
    of_tree = F.transform("nodes", lambda x: F.struct(x["lang"].alias("tree"), x["digest"].alias("subroot"), full_path(x).alias("path")))
    heads = written(heads.select(F.inline(of_tree)).withColumn("block", one), "merkle-heads", folders)

    def of(x: Column) -> Column:
        path = full_path(x)
        return F.struct(x["key"].alias("doc_id"), x["digest"].alias("leaf"), proof(path).alias("proof_sha256"), folded(F.coalesce(x["tampered"], x["digest"]), path).alias("folded_root"))

    each = descended(up, heads).select("subroot", F.inline(F.transform("nodes", of)))
    known = F.lit(root).cast("string")
    out = written(each.select("doc_id", "leaf", "subroot", known.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == known).alias("verified")), "merkle-manifest")
    discard(docs.sparkSession, folders)
    return out


_DIGITS = "list_transform(range(0, 8 * length(cast(doc_id as varchar))), lambda i: case when i % 8 = 0 then cast(ascii(substr(cast(doc_id as varchar), cast(i // 8 + 1 as integer), 1)) as bigint) else 0 end)"


def oracle_sql(levels: int = 12) -> str:
    """The manifest in SQL, for trees of up to ``8 ** levels`` leaves: a recursion that hashes all runs of a level together."""
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    text = lambda t: f"sha256({' || '.join(part(t if c == 'text' else c) for c in FIELDS)})"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    tree = lambda name, base: f"""{name} as (
  {base}
  union all
  select tree, lvl + 1, p, sha256(string_agg(h, '' order by place)), cast((any_value(n) + 7) // 8 as bigint)
  from (select *, place // {ARITY} as p from {name}) where n > 1 and lvl < {levels} group by tree, lvl, p
)"""  # noqa: E731
    kin = lambda name, nodes: f"""{name} as (
  select a.tree, a.place as leaf, b.lvl, string_agg(b.h, '' order by b.place) filter (b.place < a.place // pow({ARITY}, b.lvl)::bigint) as l,
    string_agg(b.h, '' order by b.place) filter (b.place > a.place // pow({ARITY}, b.lvl)::bigint) as r
  from {nodes} a join {nodes} b on a.tree = b.tree and a.lvl = 0 and b.n > 1 and b.place // {ARITY} = a.place // pow({ARITY}, b.lvl + 1)::bigint
  group by a.tree, a.place, b.lvl
)"""  # noqa: E731
    return f"""
with recursive d as materialized (
  select doc_id, coalesce('+' || lang, '-') as tree, {text('text')} as leaf, case when
    xor(list_reduce({_DIGITS}, lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint), 4294967295::bigint) % 3 = 0
    then {text(lower)} end as tampered from documents
), p as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n from d
), {tree('low', "select tree, 0 as lvl, place, leaf as h, n from p")}, sub as materialized (
  select tree, max_by(h, lvl) as h, max(lvl) as depth from low where n = 1 group by tree
), s as materialized (
  select 'top' as tree, tree as lang, h, depth, row_number() over (order by tree <> '-', tree) - 1 as place, count(*) over () as n from sub
), {tree('high', "select tree, 0 as lvl, place, h, n from s")}, {kin('kl', 'low')}, {kin('kh', 'high')}, path as materialized (
  select tree, leaf, lvl, coalesce(l, '') as l, coalesce(r, '') as r from kl
  union all select p.tree, p.place, s.depth + kh.lvl, coalesce(kh.l, ''), coalesce(kh.r, '') from p join s on p.tree = s.lang join kh on kh.leaf = s.place
), proofs as (
  select tree, leaf, sha256(string_agg(l || r, '' order by lvl)) as proof from path group by tree, leaf
), fold as (
  select tree, place as leaf, 0 as lvl, coalesce(tampered, leaf) as h from p
  union all select f.tree, f.leaf, f.lvl + 1, sha256(x.l || f.h || x.r) from fold f join path x on x.tree = f.tree and x.leaf = f.leaf and x.lvl = f.lvl
), root as (select max_by(h, lvl) as root from high where n = 1)
select p.doc_id, p.leaf, s.h as subroot, root.root, coalesce(proofs.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = root.root as verified
from p join s on p.tree = s.lang cross join root left join proofs on proofs.tree = p.tree and proofs.leaf = p.place
join (select tree, leaf, max_by(h, lvl) as h from fold group by tree, leaf) f on f.tree = p.tree and f.leaf = p.place
"""
