"""Operator 12, hard negatives: an inner-product kNN join over Voronoi cells of norm-augmented vectors.

Every row gets one more component, ``sqrt(M^2 - |x|^2)`` with M the largest norm, anchors get a zero: then
``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``, so the nearest rows are those of the largest inner products. Rows are assigned to
the nearest of some pivots (rows drawn by a hash of their ids); a cell of many rows is cut into several partitions, each
a file in shared storage, whose least and largest distance from the pivot are kept. Anchors are grouped by their nearest
pivot. From an anchor's distance to a pivot the triangle inequality bounds its inner products with all rows of a
partition, so a partition is replicated only to the groups that it might serve:

1. a group joins its nearest partitions, which gives each anchor a score that its last positive reaches at least;
2. partitions that might hold a better one go to the group in lists, each joined exactly by one task, best bound first
   against a rising threshold; the lists' best rows meet in a window by anchor;
3. the same for negatives, whose scores lie between two shares of the positive's, for all of an anchor's positives at once.

Nothing is sampled from the answer: what bounds can't exclude is scored. In many dimensions triangle bounds are wide, so
vectors without clusters are compared with nearly all rows (the README has the shares); the work is then the product of
anchors and rows, the memory still one partition and one group a task.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no part; rows that repeat
id, label and vector are one row, rows that share only an id are different ones; missing components of a shorter vector
count as zero; ties go by smaller id, then label, then vector; inner products must fit a long; anchors without positives and
positives without negatives have no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.dataset as dataset
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from .common import map_arrow, materialise, shared_path, ship, table

#: Rows of a partition, anchors of a group, partitions that a group joins first, partitions of one list.
PARTITION_ROWS, GROUP_ANCHORS, NEAREST, LISTED = 8192, 256, 3, 32
#: Rows a pivot stands for at the least, and the most pivots.
LEAST_CELL, MOST_PIVOTS = 64, 4096


def _ints(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of longs as a matrix, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums stay below 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 2**53 else a @ b.T


class _Partitions:
    """What a task knows of all partitions: name, cell, rows, least and largest distance from the pivot."""

    def __init__(self, root: str, summary: str):
        self.root = root
        self.norm, self.pivots, self.dim = pickle.loads(storage.read(f"{root}/pivots"))
        store, path = storage.locate(summary)
        rows = dataset.dataset(path, filesystem=store, format="parquet").to_table(["name", "cell", "least", "most"]).sort_by("name")
        self.names, self.cell = rows["name"].to_pylist(), rows["cell"].to_numpy()
        self.least, self.most = rows["least"].to_numpy(), rows["most"].to_numpy()

    def rows(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return pickle.loads(storage.read(f"{self.root}/rows-{self.names[i]}"))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that each anchor can have with a row of each partition."""
        q = anchors.astype(np.float64)
        own, m2 = (q * q).sum(axis=1)[:, None], self.norm * self.norm
        to_pivot = np.sqrt(np.maximum(0, own + m2 - 2 * q @ self.pivots[:, :-1].T))[:, self.cell]
        near = np.maximum(0, np.maximum(to_pivot - self.most, self.least - to_pivot))
        far = to_pivot + self.most
        slack = 1 + 1e-9 * (own + m2)  # of the square roots' rounding
        return (own + m2 - far * far) / 2 - slack, (own + m2 - near * near) / 2 + slack


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score descending, then id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class _Best:
    """The first k rows of each wish: a wish is an anchor, the scores it allows and whether it wants its own label."""

    def __init__(self, group, wishes, k: int, same: bool, floors=None):
        self.ids, self.labels, self.vectors = group
        self.anchor, self.low, self.high = wishes
        self.k, self.same = k, same
        self.floor = np.array(self.low if floors is None else np.maximum(self.low, floors))
        self.held: list = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.anchor]

    def may_serve(self, least: np.ndarray, most: np.ndarray) -> bool:
        """Whether a partition with these bounds (one an anchor) may hold a row that any wish still lacks."""
        return bool(((most[self.anchor] >= self.floor) & (least[self.anchor] <= self.high)).any())

    def join(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores = products(self.vectors, vectors)
        order = np.argsort(self.anchor, kind="stable")
        starts = np.searchsorted(self.anchor[order], np.arange(len(self.ids) + 1))
        for a in range(len(self.ids)):
            wishes = order[starts[a] : starts[a + 1]]
            if not len(wishes):
                continue
            s = scores[a]
            fits = (labels == self.labels[a]) == self.same
            fits &= (s >= self.floor[wishes].min()) & (s <= self.high[wishes].max())
            if self.same:  # not the anchor itself
                fits &= ~((ids == self.ids[a]) & (vectors == self.vectors[a]).all(axis=1)) if (ids == self.ids[a]).any() else True
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            at = at[np.lexsort((ids[at], -s[at]))]
            down = -s[at]
            for w in wishes:
                begin, end = np.searchsorted(down, -self.high[w], "left"), np.searchsorted(down, -self.floor[w], "right")
                take = at[begin : min(end, begin + self.k)]
                if len(take):
                    score, held = np.concatenate([self.held[w][0], s[take]]), np.concatenate([self.held[w][1], ids[take]])
                    keep = _first(score, held, self.k)
                    self.held[w] = (score[keep], held[keep])
                    if len(keep) == self.k:
                        self.floor[w] = max(self.floor[w], score[keep[-1]])


def _take(best: _Best, parts: _Partitions, listed: list[int], bounds) -> int:
    """Join the listed partitions, best bound first; the number of rows compared."""
    least, most = bounds
    compared = 0
    for i in sorted(listed, key=lambda i: (-most[:, i].max(), i)):
        if best.may_serve(least[:, i], most[:, i]):
            rows = parts.rows(i)
            best.join(*rows)
            compared += len(rows[0])
    return compared


class NearestRows:
    """Cells, partitions and anchor groups of (id, label, vec array<bigint>) rows; ``first`` joins wishes with them."""

    def __init__(self, rows: DataFrame, is_anchor, partition_rows: int = PARTITION_ROWS, group_anchors: int = GROUP_ANCHORS, pivots: int | None = None):
        spark = rows.sparkSession
        ship(spark)
        self.spark, self.root = spark, shared_path(spark, "vector-cells")
        rows = materialise(rows.dropDuplicates(["id", "label", "vec"]), "vectors")
        length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, norm2, dim = rows.agg(F.count("*"), F.max(length), F.max(F.size("vec"))).first()
        self.n, self.empty = n, n == 0
        if self.empty:
            return
        norm = float(np.sqrt(norm2)) * (1 + 1e-12)
        count = pivots or int(min(MOST_PIVOTS, max(1, min(n // LEAST_CELL, np.sqrt(n) / 4))))
        drawn = rows.select("vec", F.xxhash64("id").alias("h"), "id", "label").orderBy("h", "id", "label").limit(count).collect()
        centre = np.zeros((len(drawn), dim))
        for i, r in enumerate(drawn):
            centre[i, : len(r.vec)] = r.vec
        centre = np.unique(np.hstack([centre, np.sqrt(np.maximum(0, norm * norm - (centre * centre).sum(axis=1)))[:, None]]), axis=0)
        storage.write(f"{self.root}/pivots", pickle.dumps((norm, centre, dim)))
        root = self.root

        def assign(batches):
            norm, centre, dim = pickle.loads(storage.read(f"{root}/pivots"))
            for batch in batches:
                x = _ints(batch.column(2), dim).astype(np.float64)
                up = np.sqrt(np.maximum(0, norm * norm - (x * x).sum(axis=1)))
                flat = x @ centre[:, :-1].T
                near = flat + up[:, None] * centre[:, -1]
                cell = near.argmax(axis=1)
                away = np.sqrt(np.maximum(0, 2 * norm * norm - 2 * near[np.arange(len(x)), cell]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(away, pa.float64()), pa.array(flat.argmax(axis=1), pa.int32())],
                    names=["id", "label", "vec", "cell", "away", "seat"],
                )

        placed = map_arrow(rows.select("id", "label", "vec"), assign, "id long, label int, vec array<bigint>, cell int, away double, seat int")
        placed = materialise(placed, "vector-cells")

        def parted(df: DataFrame, by: str, most: int) -> DataFrame:
            """``df`` and ``part``: a cell of many rows is cut by a hash of the row. Cells are few, so their sizes are broadcast."""
            sizes = df.groupBy(by).agg(F.ceil(F.count("*") / most).alias("_p"))
            return df.join(F.broadcast(sizes), by).withColumn("part", F.pmod(F.xxhash64("id", "label", "vec"), F.col("_p")).cast("int")).drop("_p")

        def store(kind: str):
            def write(t: pa.Table) -> pa.Table:
                at = "cell" if kind == "rows" else "seat"
                name = f"{t[at][0].as_py()}-{t['part'][0].as_py()}"
                t = t.sort_by([("id", "ascending"), ("label", "ascending")])
                held = (t["id"].to_numpy(), t["label"].to_numpy(), _ints(t["vec"], dim))
                storage.replace(f"{root}/{kind}-{name}", pickle.dumps(held), f"-{uuid.uuid4().hex}")
                away = t["away"].to_numpy()
                return pa.table({"name": [name], "cell": pa.array([t[at][0].as_py()], pa.int32()), "rows": [len(t)], "least": [float(away.min())], "most": [float(away.max())]})

            return write

        summary = "name string, cell int, rows long, least double, most double"
        self.summary = shared_path(spark, "vector-partitions")
        parted(placed, "cell", partition_rows).groupBy("cell", "part").applyInArrow(store("rows"), summary).write.parquet(self.summary)
        anchors = parted(placed.filter(is_anchor), "seat", group_anchors).groupBy("seat", "part").applyInArrow(store("group"), summary)
        self.groups = materialise(anchors.select("name"), "anchor-groups")

    def first(self, wishes: DataFrame | None, k: int, same: bool) -> DataFrame:
        """(name, wish, anchor, score, id, place): the first ``k`` rows of each wish by score, then id.

        ``wishes``: name of the group, wish (number in the group), anchor (place in the group), low, high; none: one
        for each anchor with all scores allowed. A group's wishes are a few an anchor.
        """
        spark, root, summary = self.spark, self.root, self.summary
        endless = 1 << 62

        def wishes_of(name: str, table: pa.Table | None):
            group = pickle.loads(storage.read(f"{root}/group-{name}"))
            if table is None:
                n = len(group[0])
                return group, (np.arange(n), np.full(n, -endless), np.full(n, endless))
            t = table.sort_by("wish")
            return group, tuple(t[c].to_numpy() for c in ("anchor", "low", "high"))

        def plan(table: pa.Table) -> pa.Table:
            """Thresholds from the nearest partitions, then lists of those that might serve the group."""
            parts, name = _Partitions(root, summary), table["name"][0].as_py()
            group, asked = wishes_of(name, table if "wish" in table.column_names else None)
            best = _Best(group, asked, k, same)
            least, most = parts.bounds(group[2])
            nearest = np.argsort(-most.max(axis=0), kind="stable")[:NEAREST].tolist()
            _take(best, parts, nearest, (least, most))
            useful = [i for i in range(len(parts.names)) if best.may_serve(least[:, i], most[:, i])]
            lists = [useful[i : i + LISTED] for i in range(0, len(useful), LISTED)]
            held = pickle.dumps((asked, best.floor))
            return pa.table({"name": [name] * len(lists), "list": pa.array(range(len(lists)), pa.int32()), "parts": pa.array(lists, pa.list_(pa.int32())), "asked": pa.array([held] * len(lists), pa.binary())})

        schema = "name string, list int, parts array<int>, asked binary"
        source = (self.groups if wishes is None else wishes).groupBy("name")
        lists = materialise(source.applyInArrow(plan, schema), "partition-lists")
        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), lists.count()))

        def join(batches):
            parts = None
            for batch in batches:
                parts = parts or _Partitions(root, summary)
                for r in batch.to_pylist():
                    asked, floor = pickle.loads(r["asked"])
                    best = _Best(pickle.loads(storage.read(f"{root}/group-{r['name']}")), asked, k, same, floor)
                    compared = _take(best, parts, r["parts"], parts.bounds(best.vectors))
                    found = [(w, s, i) for w, (scores, ids) in enumerate(best.held) for s, i in zip(scores.tolist(), ids.tolist())]
                    found.append((-1, compared * len(best.ids), None))
                    wish = [f[0] for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["name"]] * len(found), pa.string()), pa.array(wish, pa.int32()), pa.array([int(best.anchor[w]) if w >= 0 else None for w in wish], pa.int32()),
                         pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())],
                        names=["name", "wish", "anchor", "score", "id"],
                    )

        found = materialise(map_arrow(lists.repartition(tasks, "name", "list"), join, "name string, wish int, anchor int, score long, id long"), "list-answers")
        #: products of an anchor and a row that were taken in the lists
        self.compared = found.filter("wish < 0").agg(F.sum("score")).first()[0] or 0
        order = Window.partitionBy("name", "wish").orderBy(F.col("score").desc(), "id")
        return found.filter("wish >= 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

    def anchor_ids(self) -> DataFrame:
        """(name, anchor, anchor_id) of all groups."""
        root = self.root

        def read(batches):
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    ids = pickle.loads(storage.read(f"{root}/group-{name}"))[0]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids, pa.int64())], names=["name", "anchor", "anchor_id"])

        return map_arrow(self.groups, read, "name string, anchor int, anchor_id long")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of (id long, label int, vec array<bigint>): for each anchor and each of its first ``positives`` rows of
    the same label, the first ``negatives`` rows of other labels with ``low`` to ``high`` percent of the positive's score."""
    space = NearestRows(rows, is_anchor)
    if space.empty:
        return rows.sparkSession.createDataFrame([], RESULT)
    near = materialise(space.first(None, positives, True), "positives")
    # ceil(low * p / 100) and floor(high * p / 100) in whole numbers
    bounds = near.select(
        "name", "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place",
        F.expr(f"{low} * score div 100 + if(pmod({low} * score, 100) > 0 and score > 0, 1, 0)").alias("low"),
        F.expr(f"{high} * score div 100 - if(pmod({high} * score, 100) > 0 and score < 0, 1, 0)").alias("high"),
    ).filter("low <= high")
    # a group's wishes are numbered: the place of a wish tells anchor and positive
    wishes = materialise(bounds.withColumn("wish", F.row_number().over(Window.partitionBy("name").orderBy("anchor", "place")) - 1), "wishes")
    far = space.first(wishes.select("name", "wish", F.col("anchor").cast("long").alias("anchor"), "low", "high"), negatives, False)
    far = far.select("name", "wish", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        far.join(wishes.select("name", "wish", "anchor", "positive_id", "positive_score"), ["name", "wish"])
        .join(space.anchor_ids(), ["name", "anchor"])
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def labelled_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, vec): whole-number components of the rows that take part; every seventh id has the next label."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()).filter(sound)
    moved = F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    return kept.select(
        F.col(vec_id).cast("long").alias("id"), moved.cast("int").alias("label"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors, all rows against every hundredth."""
    return mine(labelled_vectors(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


_SQL = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as materialized (
  select a.id as anchor_id, b.id, a.label = b.label as same, list_inner_product(a.vec, b.vec)::bigint as score
  from v a, v b where a.id % 100 = 0 and a.id <> b.id
), p as (
  select * from (select anchor_id, id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, id) as place from s where same)
  where place <= 5
), n as (
  select p.anchor_id, positive_id, positive_score, s.id as negative_id, s.score as negative_score,
    (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id))::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same
  where 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {"op12_hard_negatives": _SQL}
