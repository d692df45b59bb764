"""Model operators: random forest fit, scoring, save/load, publishing.

A forest is a table with one row per tree.  ``fit_forest`` trains on every labelled row, grows each tree in a
task of its own on its own bootstrap draw and lets the tasks write the trees; the driver never sees them.
Up to ``max_train_rows`` rows are handed to the tasks as arrays. A larger table is written once, and every
tree's task reads it as a stream, draws from it block by block and holds only its own draw; the driver sees
none of its rows. Trees are grown to the end: no depth limit unless one is given.

``score`` adds votes group by group: a group holds as many trees as ``GROUP_BYTES`` allow, goes to the
tasks as one broadcast, and the votes so far are written before the next group is read.  Neither the
driver nor a broadcast ever holds more than one group, however many trees there are.

The scaler (population mean / deviation of all training rows, F7) is kept with the model, so scoring raw
rows uses exactly the training transformation.

Defined cases: a null or NaN feature counts as lower than every number; rows without a label are not
trained on; a forest fitted on no rows knows no class and predicts null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.prepare import fit_standard
from driftline.operators.tree import FIELDS, BlockBootstrap, Packed, bootstrap, grow, grow_large, unpack
from driftline.session import scratch_path

METADATA = ("version int, path string, model_name string, num_trees int, max_depth int, features array<string>, "
            "accuracy double, previous_best double")

#: Rows that a task grows at once. A forest is fitted on all rows: of a larger table, each tree's upper nodes are split
#: one by one until a node has no more than these.
MAX_TRAIN_ROWS = 100_000
#: Rows that are drawn from together where the table is larger.
BLOCK = 1 << 16
#: A feature of a larger table is held as codes if it seems to have no more values than these.
MAX_CODES = 1 << 15
#: Records of packed rows that a task reads at once.
RECORDS = 16
#: Bytes of packed rows in a row group, which a reader holds whole.
PACKED_GROUP = 8 << 20
#: Rows that vote at once.
VOTE_ROWS = 1 << 16
#: Bytes of trees that are broadcast at once.
GROUP_BYTES = 32 << 20

TREES = "tree int, feature binary, threshold binary, left binary, shares binary"


@dataclass(frozen=True)
class Forest:
    """A fitted forest: where its trees lie and what scoring needs to know. ``max_depth`` 0: unlimited."""

    path: str
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    classes: tuple[int, ...]
    num_trees: int
    max_depth: int
    largest: int  # bytes of the largest tree

    def groups(self) -> list[tuple[int, int]]:
        """[first, last) numbers of the trees that are voted on together."""
        size = max(1, GROUP_BYTES // max(1, self.largest))
        return [(at, min(at + size, self.num_trees)) for at in range(0, self.num_trees, size)]


def _inputs(model_features: Sequence[str], means: Sequence[float], scales: Sequence[float]) -> list[Column]:
    """the scaled features; what is missing lies below everything."""
    below = F.lit(float("-inf"))
    value = [F.col(f"`{c}`").cast("double") for c in model_features]
    return [F.when(v.isNull() | F.isnan(v), below).otherwise((v - F.lit(m)) / F.lit(s)) for v, m, s in zip(value, means, scales)]


def _labelled(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The rows that have a label, as f0.. and y."""
    return train.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)],
                        F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("y").isNotNull())


def training_rows(train: DataFrame, features: Sequence[str], label: str, max_rows: int) -> pa.Table:
    """The labelled rows as f0.. and y, for a caller that knows that there are no more than ``max_rows``: the driver holds no more."""
    return _labelled(train, features, label).limit(max_rows).toArrow().combine_chunks()


def _scaled(column: pa.Array | pa.ChunkedArray, mean: float, scale: float) -> np.ndarray:
    """a scaled feature; what is missing lies below everything (all of it, where the mean is no number)."""
    with np.errstate(invalid="ignore"):
        x = (column.to_numpy(zero_copy_only=False) - mean) / scale
    return np.where(np.isnan(x), -np.inf, x)


def _written(number: int, tree: Packed) -> pa.RecordBatch:
    arrays = [pa.array([getattr(tree, k).astype(t, copy=False).tobytes()], pa.binary()) for k, t in FIELDS.items()]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *arrays], names=["tree", *FIELDS])


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _from_arrays(table: pa.Table, means: Sequence[float], scales: Sequence[float], num_trees: int, tried: int, max_depth: int | None,
                 min_instances: int, seed: int) -> tuple[DataFrame, Batches, list[int]]:
    """Numbers of trees, what grows them, and the classes: the rows go to the tasks as arrays."""
    x = np.column_stack([_scaled(table.column(i), *ms) for i, ms in enumerate(zip(means, scales))]) if len(means) else np.zeros((0, 0))
    labels = table.column("y").to_numpy()
    order = np.lexsort((labels, *x.T))  # the same trees whatever order the rows came in
    x, labels = np.ascontiguousarray(x[order]), labels[order]
    classes, y = np.unique(labels, return_inverse=True)
    n_classes = max(1, len(classes))

    def grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, number])
                yield _written(number, grow(x, y, bootstrap(len(x), rng), n_classes, rng, tried, max_depth, min_instances).packed())

    return SparkSession.active().range(0, num_trees, 1, num_trees), grow_trees, classes.tolist()


def _from_table(rows: DataFrame, n: int, means: Sequence[float], scales: Sequence[float], num_trees: int, tried: int, max_depth: int | None,
                min_instances: int, seed: int, at_once: int) -> tuple[DataFrame, Batches, list[int]]:
    """The same for any number of rows. Every tree gets them as a stream (read anew, not shuffled) and keeps what it draws."""
    spark = rows.sparkSession
    held, names = scratch_path(spark, "train"), [f"f{i}" for i in range(len(means))]
    # in order of their values: the same draws whatever order the rows came in
    rows.orderBy(*names, "y").withColumn("at", F.monotonically_increasing_id()).write.parquet(held)
    stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("at", T.LongType())])).parquet(held)
    bits = 33  # of the number within a partition
    parts = {r["part"]: r["rows"] for r in stored.groupBy(F.shiftright("at", bits).alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    sizes = np.array([parts.get(k, 0) for k in range(max(parts) + 1)])
    before = np.cumsum(sizes) - sizes
    classes = np.array(sorted(r["y"] for r in stored.select("y").distinct().collect()))
    about = stored.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    values = [np.unique(np.append(_scaled(stored.select(c).distinct().toArrow().column(0), m, s), -np.inf)) if about[c] <= MAX_CODES else None
              for c, m, s in zip(names, means, scales)]
    types = [*(np.dtype(np.float64) if v is None else np.min_scalar_type(len(v)) for v in values), np.min_scalar_type(len(classes))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that follow each other as one: the number of the first, and each column's bytes."""
        for batch in batches:
            at = batch.column("at").to_numpy()
            at = before[at >> bits] + (at & ((1 << bits) - 1))
            columns = [_scaled(batch.column(c), m, s) for c, m, s in zip(names, means, scales)]
            columns = [x if v is None else np.searchsorted(v, x) for x, v in zip(columns, values)]
            columns = [x.astype(t) for x, t in zip([*columns, np.searchsorted(classes, batch.column("y").to_numpy())], types)]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]))
            for first, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if first < end:
                    yield pa.RecordBatch.from_arrays([pa.array([at[first]], pa.int64()), *(pa.array([x[first:end].tobytes()], pa.binary()) for x in columns)],
                                                     names=["first", *names, "y"])

    packed = ", ".join(["first long", *(f"{c} binary" for c in [*names, "y"])])
    stored.mapInArrow(pack, packed).write.option("parquet.block.size", PACKED_GROUP).parquet(f"{held}-packed")

    def grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws: dict[int, BlockBootstrap] = {}
        kept: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for number, first, *held in zip(batch.column("tree").to_pylist(), batch.column("first").to_pylist(),
                                            *(batch.column(c) for c in [*names, "y"])):
                if number not in draws:  # one to a task, as the trees are dealt
                    draws[number], kept[number] = BlockBootstrap(n, BLOCK, [seed, number]), [[] for _ in range(len(types) + 1)]
                columns = [np.frombuffer(h.as_buffer(), dtype=t) for h, t in zip(held, types)]
                weight = draws[number].weights(first, first + len(columns[-1]))
                own = np.flatnonzero(weight)
                weight = weight[own]
                for k, c in enumerate(columns):
                    kept[number][k].append(c[own])
                kept[number][-1].append(weight.astype(np.min_scalar_type(int(weight.max(initial=0)))))
        for number in list(kept):
            columns, parts = [], kept.pop(number)
            while parts:  # a column at a time, so that only one is there twice
                columns.append(np.concatenate(parts.pop(0)))
            label, weight = columns[-2:]
            yield _written(number, grow_large(columns[:-2], values, label, weight, len(classes), np.random.default_rng([seed, number, n]),
                                              tried, max_depth, min_instances, at_once))

    trees = spark.range(0, num_trees, 1, num_trees).select(F.col("id").cast("int").alias("tree"))
    blocks = spark.read.schema(packed).parquet(f"{held}-packed").coalesce(1)
    return blocks.crossJoin(trees.hint("shuffle_replicate_nl")), grow_trees, classes.tolist()


@contextmanager
def _few_records(spark: SparkSession) -> Iterator[None]:
    """A record of what trees are grown from is thousands of rows: few of them are read and sent at once."""
    before = {key: spark.conf.get(key) for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    for key in before:
        spark.conf.set(key, str(RECORDS))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def fit_forest(train: DataFrame, features: Sequence[str], label: str, num_trees: int = 100, max_depth: int | None = None,
               min_instances: int = 1, seed: int = 42, max_train_rows: int = MAX_TRAIN_ROWS, path: str | None = None) -> Forest:
    """M3: scaler + random forest (square-root feature subsets, bootstrap draws, Gini) on all labelled rows.

    ``max_train_rows`` is no bound of the training: a task grows so many rows at once.
    """
    spark = train.sparkSession
    path = path or scratch_path(spark, "forest")
    stats = fit_standard(train, features)
    # nine digits, so that the order of a sum does not show in a cut that falls on a value
    means, scales = (tuple(float(f"{stats[c][k] or 0.0:.9g}") for c in features) for k in (0, 1))
    scales = tuple(s or 1.0 for s in scales)
    tried = max(1, round(math.sqrt(len(features))))
    how = (means, scales, num_trees, tried, max_depth, min_instances, seed)
    rows = _labelled(train, features, label)
    n = rows.count()
    if n <= max_train_rows:
        trees, grow_trees, classes = _from_arrays(training_rows(train, features, label, max_train_rows), *how)
    else:
        trees, grow_trees, classes = _from_table(rows, n, *how, max_train_rows)
    with _few_records(spark):
        trees.mapInArrow(grow_trees, TREES).write.mode("overwrite").parquet(f"{path}/trees")
    size = sum((F.octet_length(k) for k in FIELDS), F.lit(0))
    largest = _trees(spark, path).agg(F.max(size).alias("b")).first()["b"] or 0
    forest = Forest(path, tuple(features), means, scales, tuple(int(c) for c in classes), num_trees, max_depth or 0, largest)
    _write_about(spark, forest)
    return forest


def _trees(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREES).parquet(f"{path}/trees")


def _write_about(spark: SparkSession, forest: Forest) -> None:
    spark.createDataFrame([(json.dumps(asdict(forest)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{forest.path}/about")


def _group(spark: SparkSession, forest: Forest, first: int, end: int) -> list[Packed]:
    rows = _trees(spark, forest.path).filter(F.col("tree").between(first, end - 1)).collect()  # GROUP_BYTES at most, or one tree
    return [unpack(r.asDict()) for r in sorted(rows, key=lambda r: r["tree"])]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``VOTE_ROWS``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= VOTE_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _adding(trees: list[Packed], kept: int, n_classes: int, names: list[str]) -> Batches:
    """Adds the votes of ``trees`` to the last column; the features stand between it and the ``kept`` first columns."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            columns = batch.columns
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns[kept:-1]])
            total = columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(-1, n_classes).copy()
            for tree in trees:
                total += tree.vote(x, n_classes)
            offsets = pa.array(np.arange(0, total.size + 1, n_classes, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], names=names)

    return add


def votes(forest: Forest, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``votes``: each class's share of the votes of all trees."""
    spark = df.sparkSession
    inputs = [f"_f{i}" for i in range(len(forest.features))]
    n_classes = len(forest.classes)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(i) for c, i in zip(_inputs(forest.features, forest.means, forest.scales), inputs)],
                     F.array_repeat(F.lit(0.0), n_classes).alias("votes"))
    names, schema = rows.columns, T.StructType(rows.schema.fields)
    groups = forest.groups() if n_classes else []
    for k, (first, end) in enumerate(groups):  # the driver names no group, so that it holds one at a time
        rows = rows.mapInArrow(_adding(_group(spark, forest, first, end), len(keep), n_classes, names), schema)
        if k + 1 < len(groups):  # written, so that the next group does not keep this one alive
            held = scratch_path(spark, "votes")
            rows.write.parquet(held)
            rows = spark.read.schema(schema).parquet(held)
    share = F.transform("votes", lambda v: v / F.lit(float(max(1, forest.num_trees))))
    return rows.select(*[F.col(f"`{c}`") for c in keep], share.alias("votes"))


def score(forest: Forest, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """M4 + F8: the class with most votes (ties: the smallest) and its share of the votes (NaN/inf -> 0)."""
    clean = F.transform("votes", lambda v: F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v))
    best = F.array_max(F.col("votes"))
    classes = F.array(*[F.lit(c) for c in forest.classes]).cast("array<int>")
    return votes(forest, df, keep).select(*[F.col(f"`{c}`") for c in keep],
                                          F.get(classes, (F.array_position("votes", best) - 1).cast("int")).alias("prediction"), F.array_max(clean).alias("p_max"))


def save(forest: Forest, path: str) -> Forest:
    """The whole model below ``path``, scaler included."""
    spark = SparkSession.active()
    _trees(spark, forest.path).write.mode("overwrite").parquet(f"{path}/trees")
    saved = Forest(**{**asdict(forest), "path": path})
    _write_about(spark, saved)
    return saved


def load(path: str) -> Forest:
    facts = json.loads(SparkSession.active().read.text(f"{path}/about").first()["value"])
    return Forest(**{k: tuple(v) if isinstance(v, list) else v for k, v in facts.items()} | {"path": path})


def publish_if_better(forest: Forest, accuracy: float, best: float, folder: str, metadata: dict) -> bool:
    """K10 + M8: save the model and append its metadata row only if its accuracy beats the best one strictly.

    Each published model has a folder of its own; the metadata row (JSON lines) names it and is written last, so a
    reader of the newest row finds a whole model or the one before.
    """
    if accuracy <= best:
        return False
    spark = SparkSession.active()
    version = (newest(spark, folder) or {"version": 0})["version"] + 1
    saved = save(forest, f"{folder}/models/{version}-{scratch_path(spark, 'v').rsplit('-', 1)[1]}")
    row = {**metadata, "version": version, "path": saved.path, "accuracy": accuracy, "previous_best": best}
    spark.createDataFrame([row], METADATA).coalesce(1).write.mode("append").json(f"{folder}/metadata")
    return True


def newest(spark: SparkSession, folder: str) -> dict | None:
    """The metadata row of the model published last, if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/metadata")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.schema(METADATA).json(f"{folder}/metadata").orderBy(F.col("version").desc()).first()
    return row.asDict() if row else None
