"""Near duplicates among embeddings: int8 tile products with proven error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, written
from .components import components


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error, norm) of rows x: x / norm = scale * q + e, q of int8, and error an
    upper bound of the length of e."""
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.clip(np.rint(unit / scale[:, None]), -127, 127).astype(np.int8)
    e = unit - scale[:, None] * q
    return q, scale, np.sqrt((e * e).sum(1)) * (1 + 1e-9) + 1e-12, norm


def product_bound(scale: np.ndarray, error: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of scale * q, an upper bound."""
    return scale * np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)


def _roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a table of rows against columns: for each row and each column the
    smallest row that links reach, or the number of rows if none."""
    n, m = linked.shape
    rows = np.where(linked.any(1), np.arange(n), n)
    while True:
        cols = np.where(linked, rows[:, None], n).min(0, initial=n)
        new = np.minimum(rows, np.where(linked, cols[None, :], n).min(1, initial=n))
        if (new == rows).all():
            return rows, cols
        rows = new


def _bounds(a: dict, other: dict) -> np.ndarray:
    """An upper bound of each cosine of the rows of two tiles, from int8 values. Products of
    them are whole numbers below 2 ** 24 up to 1,000 components, which float32 holds exactly."""
    wide = np.float32 if a["q"].shape[1] <= 1000 else np.float64
    close = a["scale"][:, None] * other["scale"][None] * (a["q"].astype(wide) @ other["q"].astype(wide).T).astype(np.float64)
    return close + a["reach"][:, None] * other["error"][None] + a["error"][:, None] * (other["reach"] + other["error"])[None]


def tile_links(a: dict, b: dict | None, threshold: float) -> tuple[list, list]:
    """Of tile a against tile b (None: against itself): (node, links) sums and (node, node)
    links that connect what all links of the two tiles connect."""
    other = b or a
    close = _bounds(a, other)
    i, j = np.nonzero(close >= threshold - 1e-9)
    if b is None:
        i, j = i[i < j], j[i < j]
    linked = np.zeros(close.shape, bool)
    for s in range(0, len(i), 1 << 16):  # in full precision, only what may reach the threshold
        p, r = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        cos = np.einsum("ij,ij->i", a["x"][p], other["x"][r]) / (a["norm"][p] * other["norm"][r])
        linked[p, r] = cos >= threshold
    sums = list(zip(a["node"].tolist(), (linked @ other["copies"]).tolist(), strict=True)) + list(zip(other["node"].tolist(), (a["copies"] @ linked).tolist(), strict=True))
    if b is None:
        linked |= linked.T
    rows, cols = _roots(linked)
    n = len(rows)
    at = lambda k: int(a["node"][k])
    links = [(int(x), at(k)) for x, k in zip(a["node"], rows, strict=True) if k < n and int(x) != at(k)]
    links += [(int(x), at(k)) for x, k in zip(other["node"], cols, strict=True) if k < n and int(x) != at(k)]
    return [x for x in sums if x[1]], links


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The int8 form of each vector of a column of vectors of any lengths."""
    for b in batches:
        size = np.array(b["embedding"].value_lengths(), np.int64)
        flat, end = np.array(b["embedding"].flatten(), np.float64), np.cumsum(size)
        q: list = [None] * len(b)
        numbers = np.zeros((3, len(b)))
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            x, scale, error, _ = quantise(flat[(end[at] - d)[:, None] + np.arange(d)])
            numbers[:, at] = scale, error, product_bound(scale, error, x)
            for i, v in zip(at.tolist(), x, strict=True):
                q[i] = v.tobytes()
        yield pa.RecordBatch.from_arrays([b["node"], pa.array(q, pa.binary()), *map(pa.array, numbers)], names=["node", "q", "scale", "error", "reach"])


def near_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row (vec_id, embedding, label).

    Vectors are compared where labels are equal and not null. Equal vectors count as one
    with a weight, whatever their ids. The others of a label go to tiles of about `tile`
    vectors by a hash; each pair of tiles is a task's unit of work, so a label may hold a
    third of all rows. Each tile goes to every other of its label in int8; the product
    gives each cosine within a proven bound. Only vectors with a pair that may reach the
    threshold go to the second step with their components, and only such pairs are computed
    in double precision. A pair of tiles returns sums and at most one link a vector, not
    all its links.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    vectors of different lengths, don't link. Labels are numbers or strings of any kind. A null vec_id is counted but names no
    component. Rows that repeat are copies: they link with each other. Rows that share an
    id but not a vector are vectors of their own. An empty table gives an empty one.
    """
    label = F.col("label")
    if isinstance(vectors.schema["label"].dataType, T.FractionalType):
        label = label + F.lit(0.0)  # -0.0 and 0.0 are equal
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label.cast("string").alias("label"))
    fine = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    keyed = rows.withColumn("key", F.when(F.expr(f"coalesce({fine}, false)"), F.sha2(F.to_json(F.struct(F.transform("embedding", lambda x: x + F.lit(0.0)).alias("e"))), 256)))
    classes = keyed.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vector-classes")
    tiles = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    small = written(classes.select("node", "embedding").mapInArrow(lean(_quantised), "node long, q binary, scale double, error double, reach double"), "vectors-int8")
    placed = written(classes.select("node", "label", "dim").join(tiles, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")), "vector-tiles")
    sent = placed.join(small, "node").withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = [F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j")]
    sent = sent.select("label", "dim", *pair, "t", "node", "q", "scale", "error", "reach")

    def near(g: pa.Table) -> pa.Table:
        """The vectors of a pair of tiles that may link with one of the other tile."""
        one = g["i"][0].as_py(), g["j"][0].as_py()
        sides = []
        for t in one:
            own = g.filter(pa.compute.equal(g["t"], t))
            q = np.frombuffer(b"".join(own["q"].to_pylist()), np.int8).reshape(own.num_rows, g["dim"][0].as_py())
            sides.append({"q": q, "node": own["node"].combine_chunks()} | {c: np.array(own[c]) for c in ("scale", "error", "reach")})
        may = _bounds(*sides) >= threshold - 1e-9
        if one[0] == one[1]:
            np.fill_diagonal(may, False)
            sides.pop()
        nodes = pa.concat_arrays([s["node"].filter(pa.array(may.any(1 - k))) for k, s in enumerate(sides)])
        fixed = [pa.array([g[c][0].as_py()] * len(nodes), pa.string() if c == "label" else pa.int32()) for c in ("label", "dim", "i", "j")]
        return pa.table([*fixed, nodes], names=["label", "dim", "i", "j", "node"])

    able = written(sent.groupBy("label", "dim", "i", "j").applyInArrow(near, "label string, dim int, i int, j int, node long"), "vectors-near")
    full = able.join(placed.select("node", "t"), "node").join(classes.select("node", "copies", "embedding"), "node")

    def side(g: pa.Table, t: int) -> dict:
        own = g.filter(pa.compute.equal(g["t"], t)).sort_by("node")
        x = np.array(own["embedding"].combine_chunks().flatten()).reshape(own.num_rows, -1)
        q, scale, error, norm = quantise(x)
        return {"node": np.array(own["node"]), "copies": np.array(own["copies"]), "x": x, "q": q, "scale": scale, "error": error, "norm": norm, "reach": product_bound(scale, error, q)}

    def work(g: pa.Table) -> pa.Table:
        i, j = g["i"][0].as_py(), g["j"][0].as_py()
        present = set(g["t"].unique().to_pylist())
        sums, links = tile_links(side(g, i), side(g, j) if i != j else None, threshold) if {i, j} <= present else ([], [])
        nodes = [*(x[0] for x in sums), *(x[0] for x in links)]
        return pa.table([pa.array(nodes, pa.int64()), pa.array([*(x[1] for x in sums), *[None] * len(links)], pa.int64()), pa.array([*[None] * len(sums), *(x[1] for x in links)], pa.int64())], names=["node", "n", "other"])

    found = written(full.groupBy("label", "dim", "i", "j").applyInArrow(work, "node long, n long, other long"), "tile-links")
    counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.where("other is not null"), "node", "other").withColumnRenamed("node", "part_of")
    of = classes.select("label", "key", "node", "copies", "least").join(counts, "node", "left").join(parts, F.col("node") == F.col("part_of"), "left")
    names = of.where("component is not null").groupBy(F.col("component").alias("named")).agg(F.min("least").alias("name"))
    of = of.join(names, F.col("component") == F.col("named"), "left").where("n is not null or copies > 1")
    of = of.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("name", "least").alias("component"))
    out = keyed.select("vec_id", "label", "key").join(of, ["label", "key"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
