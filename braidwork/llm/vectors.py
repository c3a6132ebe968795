"""Embedding near-duplicates: spherical k-means cells and blocked cosine products within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components

#: Bounds of the k-means fit: vectors in its sample, and cells.
MOST_SAMPLE, MOST_CELLS = 20_000, 16_384
#: Vectors of a label for each cell, on average, and vectors in one block of products.
PER_CELL, BLOCK = 4_000, 2_048
#: How much nearer to its own cell's centre than to another's, along the line between them, a vector may
#: be and still visit the other cell. Of the differences of linked vectors, whose length is at most 0.375
#: at cosine 0.93, the part along a given line is a small one in many dimensions.
MARGIN = 0.12


def nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of largest product for each vector, the first of equal ones; 1,024 by 1,024 products at a time."""
    best, own = np.full(len(unit), -np.inf), np.zeros(len(unit), np.int64)
    for at in range(0, len(unit), 1024):
        for k in range(0, len(centres), 1024):
            near = unit[at : at + 1024] @ centres[k : k + 1024].T
            top = near.argmax(1)
            value = near[np.arange(len(near)), top]
            better = value > best[at : at + 1024]
            best[at : at + 1024][better] = value[better]
            own[at : at + 1024][better] = top[better] + k
    return own


def visits(unit: np.ndarray, centres: np.ndarray, home: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and the cells that they are in: their own one, and others nearly as close along the line between the centres."""
    rows, cells = [], []
    for at in range(0, len(unit), 1024):
        part, own = unit[at : at + 1024], home[at : at + 1024]
        here = (part * centres[own]).sum(1)[:, None]
        for k in range(0, len(centres), 1024):
            there = centres[k : k + 1024]
            width = np.sqrt(np.maximum(2 - 2 * (centres[own] @ there.T), 0))
            found = here - part @ there.T <= margin * width
            found |= own[:, None] == np.arange(k, k + len(there))
            row, cell = np.nonzero(found)
            rows.append(row + at)
            cells.append(cell + k)
    rows, cells = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cells))
    order = np.lexsort((cells, rows))
    return rows[order], cells[order]


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of unit vectors: cosine assignment, mean, renormalised; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = nearest(sample, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centres)
    return centres


def _unit(stacked: np.ndarray) -> np.ndarray:
    scale = np.abs(stacked).max(1, keepdims=True)
    stacked = stacked / scale  # against overflow and underflow of squares
    return stacked / np.linalg.norm(stacked, axis=1, keepdims=True)


def _valid(vec: str, label: str):
    """Rows that can link: a label, and a vector of finite components that are not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(label).isNotNull() & F.col(vec).isNotNull() & ~F.coalesce(F.exists(vec, bad), F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _assign(nodes: DataFrame, centres: np.ndarray, margin: float) -> DataFrame:
    """One row per node and cell: its own cell, and the cells that it visits."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS centres
    names = ["label", "cell", "node", "copies", "v", "home", "cells"]
    schema = f"label {nodes.schema['label'].dataType.simpleString()}, cell int, node {nodes.schema['node'].dataType.simpleString()}, copies long, v binary, home int, cells array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        dim = middle.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = part.column(3).to_pylist()
                unit = np.zeros((len(vectors), dim))
                fits = np.array([len(v) == dim for v in vectors], bool)
                if fits.any():
                    unit[fits] = _unit(np.array([v for v, f in zip(vectors, fits) if f], np.float64))
                home = nearest(unit, middle)
                home[~fits] = 0  # vectors of other lengths meet in the first cell
                row, cell = visits(unit, middle, home, margin)
                some = fits[row] | (cell == 0)
                row, cell = row[some], cell[some]
                lists = np.split(cell, np.searchsorted(row, np.arange(1, len(unit))))
                raw = [np.asarray(v, np.float64).tobytes() for v in vectors]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(cell, pa.int32()), part.column(1).take(take), part.column(2).take(take), pa.array([raw[i] for i in row]), pa.array(home[row], pa.int32()), pa.array([lists[i] for i in row], pa.list_(pa.int32()))],
                    names=names,
                )

    return nodes.select("label", "node", "copies", "v").mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Which of the links ``a[i]``-``b[i]`` a spanning forest needs."""
    root = np.arange(size)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    used = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            used[i] = True
    return used


def _products(threshold: float):
    """Compare two blocks of one cell (or one with itself); rows are linked pairs' counts and forest edges."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out_node, out_links, edge_a, edge_b = [], [], [], []
        length = rows["v"].str.len().to_numpy()
        for dim in np.unique(length):
            part = rows[length == dim].reset_index(drop=True)
            unit = _unit(np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), -1))
            node, copies = part["node"].to_numpy(), part["copies"].to_numpy(np.int64)
            own = (part["home"] == part["cell"]).to_numpy()
            first, side = int(part["first"].iloc[0]), part["side"].to_numpy()
            x = np.flatnonzero(side == first)
            y = np.flatnonzero(side == int(part["second"].iloc[0]))
            within = first == int(part["second"].iloc[0])
            total = np.zeros(len(part), np.int64)
            pairs_a, pairs_b = [], []
            homes, lists = part["home"].to_numpy(np.int64), part["cells"].to_numpy()
            most = 1 + max(int(homes.max()), max(int(c[-1]) for c in lists))
            visited = np.repeat(np.arange(len(part)) * most, [len(c) for c in lists]) + np.concatenate(lists)
            for at in range(0, len(x), 512):
                xs = x[at : at + 512]
                i, j = np.nonzero(unit[xs] @ unit[y].T >= threshold)
                i, j = xs[i], y[j]
                keep = (i < j) if within else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                keep = own[i] | own[j]
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                # A pair across cells can meet in both cells; the count falls to the home cell of each side,
                # and to this cell for a visitor whose home cell the other does not visit.
                mine = own[i].copy()
                other = own[j].copy()
                for side, a, b in ((mine, i, j), (other, j, i)):
                    away = np.flatnonzero(~side)
                    side[away] = ~np.isin(b[away] * most + homes[a[away]], visited)
                np.add.at(total, i[mine], copies[j[mine]])
                np.add.at(total, j[other], copies[i[other]])
                used = _forest(i, j, len(part))
                pairs_a.append(i[used])
                pairs_b.append(j[used])
            some = np.flatnonzero(total)
            out_node.append(node[some])
            out_links.append(total[some])
            if pairs_a:
                a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
                used = _forest(a, b, len(part))
                edge_a.append(node[a[used]])
                edge_b.append(node[b[used]])
        none = np.zeros(0, np.int64)
        n, c = np.concatenate([none, *out_node]), np.concatenate([none, *out_links])
        a, b = np.concatenate([none, *edge_a]), np.concatenate([none, *edge_b])
        return pd.DataFrame({"node": np.concatenate((n, a)), "links": np.concatenate((c, np.zeros(len(a), np.int64))), "other": pd.array(np.concatenate((n, b)), "Int64")}).assign(edge=np.arange(len(n) + len(a)) >= len(n))

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, margin: float = MARGIN) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Rows link when their labels are equal and the cosine of their vectors, in double precision, is at
    least ``threshold``. Equal vectors of one label are one node, so copies are counted and not paired.
    Spherical k-means, fitted on at most ``MOST_SAMPLE`` nodes, gives at most ``MOST_CELLS`` cells; every
    node is compared with all nodes of its cell, in blocks, and with the nodes near the cell's border.
    Cells of over ``BLOCK`` nodes are cut into blocks whose pairs are compared in separate tasks.

    Rows whose id, label or vector is null, whose vector is empty or zero or has a null or non-finite
    component, link with nothing: no links, their own id as component. Vectors of different lengths do
    not link. Rows that repeat an id are separate vectors, and share what the id reaches.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    given = given.withColumn("ok", F.col("id").isNotNull() & _valid("v", "label"))
    # -0.0 and 0.0 are one value, as in a product.
    given = given.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0))))
    nodes = checkpointed(given.where("ok").groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    size = nodes.count()
    if size:
        sample = nodes.select("v").orderBy(F.xxhash64("v"), "v").limit(MOST_SAMPLE).toPandas()["v"]
        lengths = sample.map(len)
        vectors = _unit(np.array(sample[lengths == lengths.mode()[0]].tolist(), np.float64))
        labels = max(1, nodes.agg(F.approx_count_distinct("label")).first()[0])
        cells = int(np.clip(-(-size // (PER_CELL // 8 * min(labels, 8))), 1, MOST_CELLS))
        placed = _assign(nodes, spherical_kmeans(vectors, cells), margin)
        counts = placed.groupBy("label", "cell").agg(F.count("*").alias("n"))
        placed = placed.join(counts, ["label", "cell"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        placed = placed.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        against = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("side")).alias("first"), F.greatest(k, F.col("side")).alias("second")))
        spread = placed.select("label", "cell", "node", "copies", "v", "home", "cells", "side", F.explode(against).alias("p")).select("*", "p.first", "p.second").drop("p")
        found = spread.groupBy("label", "cell", "first", "second").applyInPandas(_products(threshold), "node long, links long, other long, edge boolean")
        found = checkpointed(found)
        links = found.where("not edge").groupBy("node").agg(F.sum("links").alias("links"))
        roots = connected_components(found.where("edge").select("node", "other")).withColumnRenamed("node", "of")
        per = nodes.join(links, "node", "left").join(roots, F.col("node") == F.col("of"), "left")
        per = per.groupBy("label", "v").agg(F.first(F.coalesce("links", F.lit(0))).alias("links"), F.first("copies").alias("copies"), F.first(F.coalesce("root", "node")).alias("root"))
        answer = given.where("ok").join(per, ["label", "v"]).select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component_id"))
        rest = given.where("not ok")
    else:
        answer, rest = None, given
    rest = rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = rest if answer is None else answer.unionByName(rest)
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op10_embeddings``: links, component and whether it is kept, for every vector."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of one label, in double precision.
ORACLE_SQL = """
with recursive v as (
  select vec_id::bigint as vec_id, label, embedding::double[] as e from embeddings
), n as (
  select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as size from v
), pairs as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where a.size > 0 and b.size > 0 and list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from v union select r.a, p.b from reach r join pairs p on p.a = r.b
)
select v.vec_id, coalesce(l.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v left join (select a, count(*) as n from pairs group by a) l on l.a = v.vec_id
join (select a, min(b) as component_id from reach group by a) c on c.a = v.vec_id
"""
