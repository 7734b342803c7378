"""Operator 13, conversation prefix trie: nodes are shared prefixes of conversations, totals come by leaf peeling.

A node is a distinct sequence of first turns. It is known by its depth and two sums, modulo 2^62, of hashes of (place,
turn) over its turns: sums of earlier parts of a conversation add up, so no task has to hold a conversation, and texts
aren't shuffled, only digests and lengths. Places and sums come from a range sort with offsets of earlier tasks
(:func:`running`), so a conversation of any length is spread like all other rows.

The smallest member of a node names it together with its depth. Nodes with one name are a path down the trie, and each
path hangs by its top on a node of another path. Peeling works on whole paths, so a long conversation without branches is one step: a
path holds the counter of children that hang on it; paths whose counter is zero are complete, add up their nodes' totals
from the end to the top and send the top's to the node that it hangs on, with one off the counter; rounds go on until
the root's path is complete. Rounds are as many as branches lie on the way from a leaf to the root.

Defined cases: rows without a conversation id belong to none and are left out; turns come by number, null first, ties by
the MD5 of role and text; null role or text is empty; repeated rows are turns of their own; a conversation of no
turns is a member of the root; an empty table has no conversations and no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, free_shuffles, map_arrow, materialise, remove, skew_join, table

#: Rows that a sorting task takes.
ROWS_PER_TASK = 200_000
#: Hash sums are taken modulo 2^62.
_MASK = (1 << 62) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_TASK))


def running(df: DataFrame, group: str, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """``df`` with ``pos`` (from 1) and running sums (name: column) within ``group`` in ``order``; sums are taken modulo 2^62.

    Rows are range-sorted by group and order, so a large group lies in several tasks; each takes up from the totals of
    those before it. Only groups that span tasks have such totals, two a task at most, so they are broadcast.
    """
    keys = [F.col(group), *order]
    placed = df.repartitionByRange(_tasks(df), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, label).withColumn("_task", F.shiftright("_at", 33))
    # Spark's sums are checked for overflow: halves of 31 bits add up safely
    halves = {f"{name}{half}": c.cast("decimal(20,0)") for name, col in sums.items() for half, c in (("_h", F.shiftright(F.col(col).bitwiseAND(_MASK), 31)), ("_l", F.col(col).bitwiseAND((1 << 31) - 1)))}
    placed = placed.select("*", *[c.cast("long").alias(f"_{name}") for name, c in halves.items()])
    names = [f"_{name}" for name in halves]
    per = placed.groupBy(F.col(group).alias("_g"), F.col("_task").alias("_t")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"{c}s") for c in names])
    spanning = per.withColumn("_w", F.count("*").over(Window.partitionBy("_g"))).filter("_w > 1")
    before = Window.partitionBy("_g").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    base = spanning.select("_g", "_t", F.sum("_n").over(before).alias("_nb"), *[F.sum(f"{c}s").over(before).alias(f"{c}b") for c in names])
    inner = Window.partitionBy(group, "_task").orderBy("_at")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("pos", F.row_number().over(inner).cast("long"))
    for c in names:
        out = out.withColumn(f"{c}r", F.sum(c).over(upto))
    out = out.join(F.broadcast(base), (F.col(group) == F.col("_g")) & (F.col("_task") == F.col("_t")), "left")

    def whole(c: str) -> Column:
        return F.col(f"{c}r") + F.coalesce(F.col(f"{c}b"), F.lit(0))

    added = [
        (F.shiftleft(whole(f"_{name}_h") + F.shiftright(whole(f"_{name}_l"), 31), 31).bitwiseOR(whole(f"_{name}_l").bitwiseAND((1 << 31) - 1))).bitwiseAND(_MASK).alias(name)
        for name in sums
    ]
    return out.select(*df.columns, (F.col("pos") + F.coalesce("_nb", F.lit(0))).alias("pos"), *added)


def hash_at(pos: Column, digest: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), pos, digest).bitwiseAND(_MASK)


def rebuilt_turns(rows: DataFrame, shared: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, chars) of the rebuilt conversations, and all conversations (conv_id, shared, base).

    ``rows``: conv_id, turn, digest, chars. The first ``shared`` turns come from conversation ``base``, the others are own.
    """
    own = materialise(running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], {}, "turns").drop("turn"), "own-turns")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("turns")).withColumn("shared", shared).withColumn("base", base)
    lengths = convs.select(F.col("conv_id").alias("_b"), F.col("turns").alias("_turns"))
    convs = materialise(convs.join(lengths, F.col("base") == F.col("_b"), "left").select("conv_id", "turns", "shared", "base", F.least("shared", F.coalesce("_turns", F.lit(0))).alias("taken")), "conversations")
    # a base serves the conversations of its hundred, and at most its first five turns
    most = convs.agg(F.max("taken")).first()[0] or 0
    lent = own.filter(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    first = convs.filter("taken > 0").select("conv_id", "base", "taken").join(lent, "base").filter("pos <= taken").select("conv_id", "pos", "digest", "chars")
    # an own turn needs its conversation's two numbers: only those with later turns are many, and they are met once each
    later = own.join(convs.select("conv_id", "shared", "taken"), "conv_id").filter("pos > shared")
    later = later.select("conv_id", (F.col("pos") - F.col("shared") + F.col("taken")).alias("pos"), "digest", "chars")
    return first.unionByName(later), convs


def member_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, member): SHA-256 of the members, ascending, comma-joined.

    Members are range-sorted and joined to strings a task; a node's strings are hashed one after the other, so the
    largest list takes time but no memory.
    """
    keys = ["conv_id", "depth", "member"]
    placed = ends.repartitionByRange(_tasks(ends), *keys).withColumn("_task", F.spark_partition_id())
    joined = placed.groupBy("conv_id", "depth", "_task").agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("part"))
    joined = materialise(joined, "members")
    whole = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "_task")

    def digest(batches):
        at, state, names = None, None, ["conv_id", "depth", "ends_sha256"]
        for batch in batches:
            done = []
            for conv, depth, part in zip(batch["conv_id"].to_pylist(), batch["depth"].to_pylist(), batch["part"].to_pylist(), strict=True):
                if (conv, depth) != at:
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = (conv, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.encode())
            if done:
                yield pa.RecordBatch.from_pydict({n: [d[i] for d in done] for i, n in enumerate(names)}, schema=schema)
        if at:
            yield pa.RecordBatch.from_pydict({n: [x] for n, x in zip(names, (*at, state.hexdigest()), strict=True)}, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    return map_arrow(whole.select("conv_id", "depth", "part"), digest, "conv_id long, depth long, ends_sha256 string")


def peel(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved) over subtrees, from nodes (conv_id, depth, parent_conv_id, n_children, own)."""
    hanging = nodes.filter("depth > 0 and conv_id <> parent_conv_id").groupBy(F.col("parent_conv_id").alias("path")).agg(F.count("*").alias("waits"))
    opened = nodes.select("conv_id", "depth", "parent_conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("own").cast("long").alias("saved"))
    opened = opened.join(hanging, F.col("conv_id") == F.col("path"), "left").withColumn("waits", F.coalesce("waits", F.lit(0))).drop("path")
    opened = materialise(opened, "open-nodes")
    done: list[DataFrame] = []
    while not opened.isEmpty():
        complete = opened.filter("waits = 0").withColumn("down", -F.col("depth"))
        totals = running(complete, "conv_id", [F.col("down")], {"leaves_": "leaves", "saved_": "saved"}, "complete-nodes")
        totals = materialise(totals.select("conv_id", "depth", "parent_conv_id", F.col("leaves_").alias("leaves"), F.col("saved_").alias("saved")), "totals")
        done.append(totals.select("conv_id", "depth", F.col("leaves").alias("n_leaves"), "saved"))
        top = totals.filter("depth > 0 and conv_id <> parent_conv_id")
        sent = top.groupBy(F.col("parent_conv_id").alias("_c"), (F.col("depth") - 1).alias("_d")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"), F.count("*").alias("_n"))
        sent = materialise(sent, "messages")
        off = sent.groupBy(F.col("_c").alias("_p")).agg(F.sum("_n").alias("_off"))
        rest = opened.filter("waits > 0").join(sent, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left").join(off, F.col("conv_id") == F.col("_p"), "left")
        rest = rest.select(
            "conv_id", "depth", "parent_conv_id", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), (F.col("waits") - F.coalesce("_off", F.lit(0))).alias("waits"),
        )
        before, opened = opened, materialise(rest, "open-nodes")
        remove(before)
        free_shuffles(nodes.sparkSession)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def build_trie(rows: DataFrame, shared: Column, base: Column) -> DataFrame:
    """The trie of rebuilt conversations, a row a node. ``rows``: conv_id long, turn, digest, chars (see :func:`turn_rows`)."""
    turns, convs = rebuilt_turns(rows, shared, base)
    convs_count, root = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not convs_count:
        return rows.sparkSession.createDataFrame([], RESULT)
    turns = turns.select("conv_id", "pos", "chars", hash_at(F.col("pos"), F.col("digest"), 1).alias("h"), hash_at(F.col("pos"), F.col("digest"), 2).alias("g"))
    turns = turns.withColumnRenamed("pos", "depth")
    path = running(turns, "conv_id", [F.col("depth")], {"a": "h", "b": "g"}, "rebuilt-turns").drop("pos")
    # the parent's sums: without this turn
    path = path.withColumn("pa", F.when(F.col("depth") > 1, (F.col("a") - F.col("h")).bitwiseAND(_MASK)).otherwise(0)).withColumn("pb", F.when(F.col("depth") > 1, (F.col("b") - F.col("g")).bitwiseAND(_MASK)).otherwise(0))
    path = materialise(path.select("conv_id", "depth", "chars", "a", "b", "pa", "pb"), "prefixes")
    nodes = path.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb")
    )
    top = rows.sparkSession.createDataFrame([(0, 0, 0, root, convs_count, 0, None, None)], "depth long, a long, b long, conv_id long, n_convs long, chars long, pa long, pb long")
    nodes = materialise(nodes.unionByName(top.select(*[F.col(c).cast(dict(nodes.dtypes)[c]) for c in nodes.columns])), "nodes")

    def key(d: Column, a: Column, b: Column) -> Column:
        return F.concat_ws("/", d.cast("string"), a.cast("string"), b.cast("string"))

    children = nodes.filter("depth > 0").groupBy(key(F.col("depth") - 1, F.col("pa"), F.col("pb")).alias("key")).agg(F.count("*").alias("n_children"))
    keyed = nodes.withColumn("key", key(F.col("depth"), F.col("a"), F.col("b"))).join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    keyed = materialise(keyed, "keyed-nodes")
    total = nodes.count()
    # a parent may have a third of all nodes below it
    parents = keyed.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    below = keyed.withColumn("parent", F.when(F.col("depth") > 0, key(F.col("depth") - 1, F.col("pa"), F.col("pb"))))
    named = skew_join(below, parents, "parent", "weight", total, F.xxhash64("key"))
    named = materialise(named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), "key"), "named-nodes")

    # a conversation ends at its last turn's node; a node may be the end of a third of all
    last = path.groupBy("conv_id").agg(F.max_by(F.struct("depth", "a", "b"), "depth").alias("e"))
    ends = convs.select("conv_id").join(last, "conv_id", "left").select(F.col("conv_id").alias("member"), F.coalesce(key(F.col("e.depth"), F.col("e.a"), F.col("e.b")), F.lit("0/0/0")).alias("end"))
    ends = ends.withColumn("end", F.when(F.col("end") == "", "0/0/0").otherwise(F.col("end")))
    ends = materialise(ends, "ends")
    weights = named.select(F.col("key").alias("end"), F.col("n_convs").alias("weight"), "conv_id", "depth")
    weights = weights.join(ends.groupBy("end").agg(F.count("*").alias("_w")), "end").select("end", F.col("_w").alias("weight"), "conv_id", "depth")
    ends = skew_join(ends, weights, "end", "weight", convs_count, F.xxhash64("member")).select("conv_id", "depth", "member")
    hashes = materialise(member_hashes(ends), "end-hashes")

    out = named.drop("key").join(peel(named), ["conv_id", "depth"]).join(hashes, ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")
    )


def turn_rows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, digest, chars): the MD5 of role and text, told apart by the role's length, and code points of the text."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return df.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("digest"), F.length(t).cast("long").alias("chars"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt on the first of their hundred."""
    rows = turn_rows(table(spark, sf_dir, "conversations"))
    return build_trie(rows, crc_mod(F.col("conv_id"), 6), F.col("conv_id") - F.col("conv_id") % 100)


_SQL = """
with recursive steps(n, c, k) as (
  select n, n, 0 from range(256) r(n)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8
), crc as (select list(c order by n) as t from steps where k = 8),
t as (
  select conv_id, turn, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null
), c as materialized (
  select conv_id, list(struct_pack(digest, chars) order by turn nulls first, digest) as turns from t group by conv_id
), h as (
  select conv_id, turns, conv_id - conv_id % 100 as base,
    (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda s, b: xor(s >> 8, crc.t[(xor(s, b) & 255) + 1])), 4294967295::bigint) % 6)::int as h
  from c, crc
), r as materialized (
  select h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) as turns from h left join c b on b.conv_id = h.base
), m as materialized (
  select conv_id, d as depth, len(turns) as n, md5(array_to_string(list_transform(list_slice(turns, 1, d), lambda x: x.digest), ',')) as node,
    case when d > 0 then md5(array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda x: x.digest), ',')) end as up,
    case when d > 0 then turns[d].chars else 0 end as chars
  from (select *, unnest(range(0, len(turns) + 1)) as d from r)
), nodes as materialized (
  select depth, node, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256
  from m group by depth, node
), kids as (select depth - 1 as depth, up as node, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as materialized (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on n.depth = k.depth and n.node = k.node),
above as (
  select f.depth, f.node, a.depth as up_depth, a.node as up_node from full_nodes f join m a on a.conv_id = f.conv_id and a.depth <= f.depth
), sums as (
  select up_depth as depth, up_node as node, sum(case when f.n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((f.n_convs - 1) * f.chars)::bigint as saved_tokens
  from above a join full_nodes f on f.depth = a.depth and f.node = a.node group by all
)
select f.conv_id, f.depth::bigint as depth, p.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children, n_leaves, saved_tokens, f.ends_sha256
from full_nodes f join sums s on s.depth = f.depth and s.node = f.node left join nodes p on p.depth = f.depth - 1 and p.node = f.up
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {"op13_prefix_trie": _SQL}
