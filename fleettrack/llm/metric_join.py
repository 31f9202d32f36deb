"""Exact range join of embeddings under cosine, by pivots and the triangle inequality.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Equal vectors are taken as one first. Pivots (a label's distinct
vectors with the smallest hashes) partition each label's vectors: a vector's home cell is that of its nearest pivot, and it is also
copied to every cell q with d(v, q) - d(v, home) <= 2r, the triangle inequality's bound, unless the bisecting plane of the
two pivots is further than r away, which is the sharper bound that holds in Euclidean space. So each vector meets in its home cell all
that it can link with, and cells join on their own: blocks of home vectors against blocks of all vectors in the cell.
A block join keeps counts and a spanning forest of its links instead of the links themselves.

Contracts: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing and are their own
component; vectors of unlike lengths never link; repeated vec_ids are one vector each row for counts, and one node for components;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored
from .components import components

BLOCK = 2048
#: Of all labels together: larger tables get larger cells, which blocks divide.
MOST_PIVOTS = 32768


def _classes(rows: DataFrame) -> DataFrame:
    """Vectors that can link: one row for each distinct (label, embedding), with its smallest id and number of rows."""
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good = rows.where(ok).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0))
    return good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def _unit(values) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in values])
    scale = np.abs(x).max(1)
    x = x / scale[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _cells(classes: DataFrame, cosine: float, per_cell: int, most_pivots: int) -> DataFrame:
    """Rows (cell, home, rep, copies, embedding): every vector in its home cell and as a copy where it may link."""
    order = Window.partitionBy("label", "dim").orderBy("h", "rep")
    sized = classes.select("label", F.size("embedding").alias("dim"), "rep", F.xxhash64("rep").alias("h"))
    n = sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    wanted = lambda size: F.least(F.lit(most_pivots), F.ceil(F.col("n") / size)).cast("int")
    total = n.select(wanted(per_cell).alias("want")).where("want > 1").agg(F.sum("want")).first()[0] or 0
    want = wanted(per_cell * max(1, -(-total // MOST_PIVOTS)))
    # a threshold on the hash first, so that no window sorts all vectors of a label: twice the wanted number is expected below it
    share = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    n = n.withColumn("want", want).where("want > 1")  # a label with one cell needs no pivot
    near = sized.join(n, ["label", "dim"]).where(share <= F.greatest(4 * F.col("want"), F.lit(16)) / F.col("n"))
    picked = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("want")).select("rep")
    rows = classes.join(picked, "rep", "left_semi").select("label", "embedding").collect()  # about MOST_PIVOTS at most
    pivots: dict = {}
    for r in rows:
        pivots.setdefault((r["label"], len(r["embedding"])), []).append(r["embedding"])
    cloud = classes.sparkSession.sparkContext.broadcast({k: _unit(sorted(v)) for k, v in pivots.items()})
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9

    def run(parts):
        known = cloud.value
        for pdf in parts:
            for (label, dim), part in pdf.groupby(["label", "dim"], sort=False):
                p = known.get((label, dim))
                if p is None:
                    p = np.eye(1, dim)
                x = _unit(part["embedding"])
                dot = np.clip(x @ p.T, -1, 1)
                dist = np.sqrt(2 - 2 * dot)
                home = dist.argmin(1)
                own = dist[np.arange(len(x)), home]
                gap = np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 0))[home]
                plane = (dist**2 - own[:, None] ** 2) <= 2 * radius * gap + 1e-9
                into = (dist - own[:, None] <= 2 * radius + 1e-9) & plane
                into[np.arange(len(x)), home] = True
                row, cell = np.nonzero(into)
                yield pd.DataFrame({"cell": [f"{label}/{dim}/{c}" for c in cell], "home": cell == home[row], "rep": part["rep"].to_numpy()[row], "copies": part["copies"].to_numpy()[row], "embedding": part["embedding"].to_numpy()[row]})

    dims = classes.select("label", F.size("embedding").alias("dim"), "rep", "copies", "embedding")
    kind = dict(classes.dtypes)["embedding"]
    return dims.mapInPandas(run, f"cell string, home boolean, rep long, copies long, embedding {kind}")


def _join(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block of home vectors against one block of the cell: links by vector, and each vector's component here."""
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "other": []}).astype("int64")
        a, b = np.array(left["embedding"].tolist(), np.float64), np.array(right["embedding"].tolist(), np.float64)
        sa, sb = np.abs(a).max(1), np.abs(b).max(1)
        a, b = a / sa[:, None], b / sb[:, None]
        cos = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
        ra, rb = left["rep"].to_numpy(), right["rep"].to_numpy()
        hit = (cos >= cosine) & (ra[:, None] != rb[None, :])
        links = hit @ right["copies"].to_numpy()
        best = ra.copy()
        far = np.iinfo(np.int64).max
        label_b = rb.copy()
        while True:  # labels fall to the smallest id that links reach within the two blocks
            new_a = np.minimum(best, np.where(hit, label_b[None, :], far).min(1))
            new_b = np.minimum(label_b, np.where(hit, new_a[:, None], far).min(0))
            if (new_a == best).all() and (new_b == label_b).all():
                break
            best, label_b = new_a, new_b
        edge_b = label_b != rb
        return pd.DataFrame({"rep": np.concatenate([ra, rb[edge_b]]), "links": np.concatenate([links, np.zeros(int(edge_b.sum()), np.int64)]), "other": np.concatenate([best, label_b[edge_b]])})

    return run


def range_join(vectors: DataFrame, cosine: float = 0.98, per_cell: int = 512, most_pivots: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors`."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    classes = stored(_classes(rows), "vector-classes")
    cells = stored(_cells(classes, cosine, per_cell, most_pivots), "vector-cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("ni"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nj"))
    dealt = cells.join(sizes, "cell")
    slot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = dealt.where("home").withColumn("i", slot("ni")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("side", F.lit(0))
    right = dealt.where(F.col("ni") > 0).withColumn("j", slot("nj")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("side", F.lit(1))
    tasks = left.unionByName(right).select("cell", "i", "j", "side", "rep", "copies", "embedding")
    tasks = tasks.repartition(shuffle_width(vectors), "cell", "i", "j")
    found = stored(tasks.groupBy("cell", "i", "j").applyInPandas(_join(cosine), "rep long, links long, other long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("rep") != F.col("other")).select(F.col("rep").alias("a"), F.col("other").alias("b"))
    comp = components(edges)
    known = classes.join(links, "rep", "left").join(comp, classes["rep"] == comp["node"], "left").select("label", "embedding", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = known.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), "component", "links")
    both = rows.join(known, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    out = both.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
