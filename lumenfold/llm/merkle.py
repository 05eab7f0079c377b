"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Rows are hashed to leaves. Per language the leaves stand in the order of doc_id,
and every ``FAN`` consecutive nodes become their hash until one is left, the
language's subroot; the subroots, in the order of their languages, become the
root in the same way.

A proof needs a leaf's siblings on every level. Each node above the leaves holds
a segment: the siblings it meets on the way to some ancestor, at first its
parent. Each round joins the table with itself on that ancestor and appends the
ancestor's own segment, so distances double and all nodes reach the root after a
number of rounds logarithmic in the depth. The leaves are held by runs of
``FAN``; each run meets its parent's whole segment once.

Positions come from sorted range partitions and their sizes, so no task sorts a
whole language, and a frequent ancestor's rows are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import hot_keys, salted_join
from lumenfold.session import discard, keep

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree of the subroots; a language's tree is named by "+" and the language, or "" for null.
TOP = "top"
_SEGMENT = "array<struct<before:string,after:string>>"
#: Rows of a task at least, as upper levels are small however many partitions a shuffle has.
TASK_ROWS = 20_000


def _tasks(table: DataFrame, rows: int) -> DataFrame:
    return table.coalesce(1 + rows // TASK_ROWS)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def leaf_of(*values: Column) -> Column:
    """Hash of some values: each as its number of UTF-8 bytes, a colon and itself, null as ``-``."""
    written = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in written]), 256)


def _positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 within their tree by ``order``, and ``size``, the tree's number of rows.

    ``rows`` is a written table. It is sorted by range partitions; a row's place
    is its place within its partition and tree, and the sizes of those before.
    """
    parts = min(1 + rows.count() // TASK_ROWS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, tree, *order) if parts > 1 else rows.coalesce(1)
    ranged = keep(dealt.withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(tree, "part").agg(F.count("*").alias("n"))
    # A row per tree and partition it lies in.
    earlier = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col(tree).alias("_tree"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"),
        F.sum("n").over(Window.partitionBy(tree)).alias("size"),
    )
    local = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order)) - 1
    placed = ranged.withColumn("local", local).join(shifts, (F.col(tree) == F.col("_tree")) & (F.col("part") == F.col("_part")))
    return placed.withColumn("idx", (F.col("local") + F.col("shift")).cast("long")).drop("local", "shift", "part", "_tree", "_part")


def _node(tree: Column, level: Column, idx: Column) -> Column:
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


def _runs(nodes: DataFrame, *payload: str) -> DataFrame:
    """(tree, run, size, members): the nodes of each run of ``FAN``, in order."""
    member = F.struct("idx", "hash", *payload)
    return nodes.groupBy("tree", F.floor(F.col("idx") / FAN).cast("long").alias("run"), "size").agg(F.array_sort(F.collect_list(member)).alias("members"))


def _siblings(members: Column, k: Column) -> Column:
    """Hashes before and after the k-th member of a run, each joined."""
    hashes = F.transform(members, lambda m: m["hash"])
    return F.struct(
        F.array_join(F.slice(hashes, 1, k), "").alias("before"),
        F.array_join(F.slice(hashes, k + 2, F.lit(FAN)), "").alias("after"),
    )


def _levels(nodes: DataFrame, first: int) -> tuple[list[DataFrame], DataFrame]:
    """Climb from ``nodes`` (tree, idx, size, hash) at level ``first``: (links of the nodes that have a parent, the trees' last nodes).

    A link is (node, up, segment, subroot): the parent and the siblings on the way to it.
    """
    links, ends, level = [], [], first
    most, n = nodes.agg(F.max("size"), F.count("*")).first()
    most = most or 0
    while True:
        ends.append(nodes.where("size = 1").select("tree", F.lit(level).alias("level"), "hash"))
        if most <= 1:
            break
        runs = keep(_tasks(_runs(nodes.where("size > 1")), n), f"runs-{level}")
        n = runs.count()
        tree, at, up = F.col("tree"), F.lit(level), F.lit(level + 1)
        each = runs.select("tree", "run", "members", F.posexplode(F.transform("members", lambda m: m["idx"])).alias("k", "idx"))
        links.append(
            each.select(
                _node(tree, at, F.col("idx")).alias("node"), _node(tree, up, F.col("run")).alias("up"),
                F.array(_siblings(F.col("members"), F.col("k"))).cast(_SEGMENT).alias("segment"), F.lit(None).cast("string").alias("subroot"),
            )
        )
        whole = F.sha2(F.array_join(F.transform("members", lambda m: m["hash"]), ""), 256)
        nodes = runs.select("tree", F.col("run").alias("idx"), F.ceil(F.col("size") / FAN).cast("long").alias("size"), whole.alias("hash"))
        most, level = -(-most // FAN), level + 1
    last = ends[0]
    for end in ends[1:]:
        last = last.union(end)
    return links, keep(_tasks(last, n), "ends")


def _jumped(links: DataFrame) -> DataFrame:
    """(node, segment, subroot) of all nodes, their segments reaching the root: each round doubles the distance."""
    n = links.count()
    held = keep(_tasks(links, n), "pointers")
    while held.where("up is not null").head(1):
        going = held.where("up is not null")
        wanted = going.groupBy("up").agg(F.count("*").alias("n"))
        beyond = held.join(wanted.select(F.col("up").alias("node")), "node", "left_semi").select(
            F.col("node").alias("up"), F.col("up").alias("next"), F.col("segment").alias("more"), F.col("subroot").alias("later")
        )
        met = salted_join(going, beyond, ["up"], hot_keys(wanted, ["up"]), ["node"])
        jumped = met.select("node", F.col("next").alias("up"), F.concat("segment", "more").alias("segment"), F.coalesce("subroot", "later").alias("subroot"))
        further = keep(_tasks(held.where("up is null").select("node", "up", "segment", "subroot").union(jumped), n), "pointers")
        discard(held)
        held = further
    return held.select("node", "segment", "subroot")


def fold(leaf: Column, segment: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(segment, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof (array of siblings before and after, level by level) and ``changed``.

    ``changed`` is the leaf of the row with its text's A-Z in lower case where 3
    divides the crc32 of doc_id, and null elsewhere and for rows without doc_id.
    Nulls are leaves' values like others. Rows without doc_id come first in
    their language; rows of equal doc_id are ordered by their leaves. An empty
    table has no root and gives an empty result. Columns other than ``FIELDS``
    are ignored.
    """
    kinds = {"doc_id": "long", "n_chars": "long"}
    plain = docs.select(*[F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in FIELDS])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = keep(
        plain.select(
            F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("tree"), "doc_id", leaf_of(*[F.col(c) for c in FIELDS]).alias("hash"),
            F.when(tampered, leaf_of(*[F.col(c) for c in FIELDS[:-1]], lower_ascii(F.col("text")))).alias("changed"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    placed = _positions(leaves, "tree", ["doc_id", "hash", "row"])
    alone = F.col("size") == 1
    # Level 0, with what the result needs of each leaf; a lone leaf is its tree's subroot and has no run to hash.
    runs = keep(_tasks(_runs(placed, "doc_id", "changed"), leaves.count()), "leaf-runs")
    hashes = F.transform("members", lambda m: m["hash"])
    above = runs.select(
        "tree", F.col("run").alias("idx"), F.ceil(F.col("size") / FAN).cast("long").alias("size"),
        F.when(alone, hashes[0]).otherwise(F.sha2(F.array_join(hashes, ""), 256)).alias("hash"),
    )
    links, ends = _levels(keep(above, "level-1"), 1)
    top = _positions(ends.select(F.lit(TOP).alias("tree"), "hash", F.col("tree").alias("of"), "level"), "tree", ["of"])
    subroots = keep(_tasks(_runs(top, "of", "level"), ends.count()), "subroot-runs")
    single = F.col("size") == 1
    each = subroots.select("run", "size", "members", F.posexplode("members").alias("k", "m"))
    # The subroots' own links lead into the top tree.
    bridge = each.select(
        _node(F.col("m.of"), F.col("m.level"), F.lit(0)).alias("node"),
        F.when(~single, _node(F.lit(TOP), F.lit(1), F.col("run"))).alias("up"),
        F.when(single, F.array().cast(_SEGMENT)).otherwise(F.array(_siblings(F.col("members"), F.col("k"))).cast(_SEGMENT)).alias("segment"),
        F.col("m.hash").alias("subroot"),
    )
    top_hashes = F.transform("members", lambda m: m["hash"])
    upper = keep(subroots.select(
        F.lit(TOP).alias("tree"), F.col("run").alias("idx"), F.ceil(F.col("size") / FAN).cast("long").alias("size"),
        F.when(single, top_hashes[0]).otherwise(F.sha2(F.array_join(top_hashes, ""), 256)).alias("hash"),
    ), "top-1")
    top_links, top_end = _levels(upper, 1)
    end = top_end.first()
    root = end["hash"] if end else None
    nothing = F.array().cast(_SEGMENT)
    last = top_end.select(
        _node(F.lit(TOP), F.col("level"), F.lit(0)).alias("node"), F.lit(None).cast("struct<tree:string,level:int,idx:bigint>").alias("up"),
        nothing.alias("segment"), F.lit(None).cast("string").alias("subroot"),
    )
    whole = bridge.union(last)
    for link in [*links, *top_links]:
        whole = whole.union(link)
    jumped = _jumped(whole)
    below = runs.select(_node(F.col("tree"), F.lit(1), F.col("run")).alias("node"), "members", alone.alias("alone"))
    met = below.join(jumped, "node")
    own = lambda k: F.when(F.col("alone"), nothing).otherwise(F.array(_siblings(F.col("members"), k)).cast(_SEGMENT))
    spread = met.select("members", "alone", "segment", "subroot", F.posexplode("members").alias("k", "m"))
    return spread.select(
        F.col("m.doc_id").alias("doc_id"), F.col("m.hash").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        F.concat(own(F.col("k")), "segment").alias("proof"), F.col("m.changed").alias("changed"),
    )


def verified(found: DataFrame) -> DataFrame:
    """Rows of :func:`manifest` with the proof as a hash, and the root recomputed from the changed leaf, or else from the leaf."""
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    folded = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof"))).withColumn("proof_sha256", F.sha2(siblings, 256))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL writes out: 8^7 rows a language and 8^3 languages.
_SQL_LEVELS, _SQL_TOP = 7, 3


def _sql() -> str:
    written = lambda text: "concat(" + ", ".join(
        f"coalesce(strlen({v}::varchar) || ':' || ({v}::varchar), '-')" for v in ("doc_id", "source", "lang", "n_chars", text)
    ) + ")"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
    parts = [f"""l0 as (select doc_id, coalesce('+' || lang, '') t, sha256({written("text")}) leaf, sha256({written("text")}) h,
  case when {crc} % 3 = 0 then sha256({written(lower)}) end changed, row_number() over (partition by lang order by doc_id) - 1 i, count(*) over (partition by lang) n from documents),
n0 as (select t, i, n, h from l0)"""]

    def climb(name: str, level: int) -> str:
        node = f"{name}{level}"
        return f"""g{node} as (select t, i // {FAN} i, any_value(n) n, list(h order by i) hs from {node} group by t, i // {FAN}),
{name}{level + 1} as (select t, i, ceil(n / {FAN})::bigint n, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end h from g{node})"""

    parts += [climb("n", k) for k in range(_SQL_LEVELS)]
    parts.append(f"s as (select t, h subroot from n{_SQL_LEVELS}), m0 as (select 'top' t, row_number() over (order by t) - 1 i, count(*) over () n, subroot h, t lt from s)")
    parts += [climb("m", k) for k in range(_SQL_TOP)]
    # Per leaf: the run on each level, left out once one node remains.
    joins, before, after, steps = [], [], [], []
    for k in range(_SQL_LEVELS):
        joins.append(f"join gn{k} a{k} on a{k}.t = l0.t and a{k}.i = l0.i // {FAN ** (k + 1)}")
        steps.append((f"a{k}", f"(l0.i // {FAN ** k} % {FAN})"))
    joins.append("join s on s.t = l0.t join m0 on m0.lt = l0.t")
    for k in range(_SQL_TOP):
        joins.append(f"join gm{k} b{k} on b{k}.i = m0.i // {FAN ** (k + 1)}")
        steps.append((f"b{k}", f"(m0.i // {FAN ** k} % {FAN})"))
    proof = ", ".join(f"case when {a}.n = 1 then '' else concat(array_to_string({a}.hs[:{p}], ''), array_to_string({a}.hs[{p} + 2:], '')) end" for a, p in steps)
    listed = ", ".join(
        f"struct_pack(one := {a}.n = 1, b := array_to_string({a}.hs[:{p}], ''), a := array_to_string({a}.hs[{p} + 2:], ''))" for a, p in steps
    )
    parts.append(f"""f as (select doc_id, leaf, subroot, (select h from m{_SQL_TOP}) root, sha256(concat({proof})) proof_sha256,
  coalesce(changed, leaf) start, [{listed}] steps from l0 {' '.join(joins)})""")
    folded, at = "start", []
    for k in range(len(steps)):
        at.append(f"f{k} as (select *, case when steps[{k + 1}].one then {folded if k == 0 else f'h{k - 1}'} else sha256(concat(steps[{k + 1}].b, {folded if k == 0 else f'h{k - 1}'}, steps[{k + 1}].a)) end h{k} from {'f' if k == 0 else f'f{k - 1}'})")
    last = len(steps) - 1
    return f"with {', '.join(parts + at)} select doc_id, leaf, subroot, root, proof_sha256, h{last} folded_root, h{last} = root verified from f{last}"


ORACLE = _sql()
