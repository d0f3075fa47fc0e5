"""Exact Jaccard self-join on word shingles, with skips from relations between sets.

1. Sets. Every text's distinct shingles, as sorted 64-bit hashes. Equal sets become one.
2. Shared shingles. Tasks count, in hash buckets, which shingles occur in more than one
   set. A set with fewer shared shingles than the threshold's share of its size links
   with nothing, and is out. Blocks of documents count within themselves first, so that
   a very common shingle costs one entry a block.
3. Index. The prefix of a set, in order of rising frequency, is listed by shingle; linked
   sets always meet in a list. Lists are kept in blocks by position.
4. Answers. Each set is compared with the smallest one of the list of its most common
   and of its rarest prefix shingle: near copies of one text meet in one star. Where the
   stars have put all of a list into one component, the list is skipped if only components
   are asked for. In other lists, the sets outside the list's largest component are compared
   with all; if all links are asked for, every list's sets with each other. Blocks and
   entries whose position leaves too few shingles are skipped. The overlap of x with y is
   bounded by the overlap of x with the centre r of y's star, which is computed once, and
   the known size of y minus r: pairs below the threshold by that are skipped, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, string_buffers, written
from .components import components
from .words import U, Words, chunks, mix, windows

POSITIONS = 16  # of an index block
SEVERAL = 0xFFFFFFFF  # the owner of a key that more than one set of its block has


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(buf, offsets, lower=True)
    h = w.hashes()
    win, at = windows(h, w.first, k)
    cut = np.searchsorted(at, w.first)
    n = np.diff(w.first)
    out = []
    for d in range(len(n)):
        if 0 < n[d] < k:  # the whole sequence is the one shingle
            acc = U(n[d])
            with np.errstate(over="ignore"):
                for x in h[w.first[d] : w.first[d + 1]]:
                    acc = mix(np.array([acc * U(31) + x], U))[0]
            out.append(np.array([acc], U))
        else:
            s = np.sort(win[cut[d] : cut[d + 1]])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit digests a set, shape (sets, 2)."""
    out = np.zeros((len(sets), 2), U)
    for i, s in enumerate(sets):
        m = mix(s ^ U(0xD1B54A32D192ED03))
        out[i] = m.sum(dtype=U) + U(len(s)), np.bitwise_xor.reduce(mix(m)) if len(s) else 0
    return out


def measured(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(doc_id, n, d1, d2, shared): the size and digests of each row's set, and how many of
    its shingles also occur in a different set. `shared` may be too large by chance, never
    too small: within a bucket, 32 bits stand for a shingle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = "bucket int, block string, ids array<long>, sizes array<int>, d1 array<long>, d2 array<long>, found array<int>, keys binary, owners binary, counts binary, marks binary"
    names = [x.split()[0] for x in sent.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            buf, off = string_buffers(b.column(1))
            for a, z in chunks(off, 3 << 20):
                sets = shingle_sets(buf[off[a] : off[z]], off[a : z + 1] - off[a], k)
                dig = digests(sets)
                _, reps, own = np.unique(dig[:, 0] ^ mix(dig[:, 1]), return_index=True, return_inverse=True)
                h = np.concatenate([sets[r] for r in reps])
                owner = np.repeat(np.arange(len(reps), dtype=np.uint32), [len(sets[r]) for r in reps])
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                size = np.diff(np.r_[start, len(h)])
                several = np.repeat(size > 1, size)
                found = np.bincount(owner[several], minlength=len(reps))  # shared inside the block
                h, owner = h[start], np.where(size > 1, SEVERAL, owner[start]).astype(np.uint32)
                to = ((h >> U(32)) % U(buckets)).astype(np.int32)
                order = np.lexsort((owner, to))
                keys, owner, to, block = (h[order] & U(0xFFFFFFFF)).astype(np.uint32), owner[order], to[order], f"{part}-{seq}"
                # a bucket gets its keys by their sets, and of these only the ones it has keys of
                run = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (owner[1:] != owner[:-1])]) if len(to) else np.zeros(0, np.int64)
                who, many = owner[run], np.diff(np.r_[run, len(to)]).astype(np.uint32)
                mark = np.r_[dig[reps, 0], U(0)][np.minimum(who, len(reps))]
                full, first = np.unique(to, return_index=True)
                cuts, runs = np.r_[first, len(to)], np.searchsorted(run, np.r_[first, len(to)])
                got = [
                    (int(x), block, None, None, None, None, None, keys[cuts[i] : cuts[i + 1]].tobytes(), *(v[runs[i] : runs[i + 1]].tobytes() for v in (who, many, mark)))
                    for i, x in enumerate(full)
                ]
                got.append((seq % buckets, block, b.column(0)[a:z].to_pylist(), [len(s) for s in sets], dig[:, 0].view(np.int64), dig[:, 1].view(np.int64), np.r_[found[own], own].astype(np.int32), None, None, None, None))
                seq += 1
                for x in range(0, len(got), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[x : x + 64], strict=True), kinds, strict=True)], names=names)

    def count(group: pa.Table) -> pa.Table:
        """A bucket: which keys belong to more than one set; to each block, how many of
        each of its sets' keys do."""
        info = group.filter(group["keys"].is_null())
        rows = group.filter(group["keys"].is_valid())
        out = [x for x in zip(*(info[c].to_pylist() for c in names), strict=True)]
        if rows.num_rows:
            keys, owners, counts = ([np.frombuffer(x.as_buffer(), np.uint32) for x in rows[c]] for c in ("keys", "owners", "counts"))
            marks = np.concatenate([np.frombuffer(x.as_buffer(), U) for x in rows["marks"]])
            all_keys, owner, many = np.concatenate(keys), np.concatenate(owners), np.concatenate(counts)
            order = np.argsort(all_keys, kind="stable")
            k, s, m = all_keys[order], np.repeat(marks, many)[order], np.repeat(owner == SEVERAL, many)[order]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[start, len(k)])
            shared = np.logical_or.reduceat(m | (s != np.repeat(s[start], size)), start)
            flag = np.zeros(len(k), bool)
            flag[order] = np.repeat(shared, size)
            n = np.add.reduceat(flag, np.r_[0, np.cumsum(many[:-1], dtype=np.int64)], dtype=np.uint32)
            n[owner == SEVERAL] = 0  # the block knows of these
            at = 0
            for block, o in zip(rows["block"].to_pylist(), owners, strict=True):
                some = np.flatnonzero(n[at : at + len(o)])
                if len(some):
                    out.append((None, block, None, None, None, None, None, None, o[some].tobytes(), n[at + some].tobytes(), None))
                at += len(o)
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def add(group: pa.Table) -> pa.Table:
        """A block: the counts of its buckets together."""
        info = group.filter(group["sizes"].is_valid())
        n = len(info["sizes"][0])
        first = info["found"][0].values.to_numpy(zero_copy_only=False)
        own, total = first[n:], np.zeros(n, np.int64)
        rows = group.filter(group["sizes"].is_null())
        for o, c in zip(rows["owners"], rows["counts"], strict=True):
            total[np.frombuffer(o.as_buffer(), np.uint32)] += np.frombuffer(c.as_buffer(), np.uint32)
        shared = first[:n].astype(np.int64) + total[own]
        cols = [info["ids"][0].values, info["sizes"][0].values.cast(pa.int64()), info["d1"][0].values, info["d2"][0].values, pa.array(shared)]
        return pa.table(cols, names=["doc_id", "n", "d1", "d2", "shared"])

    counted = rows.mapInArrow(lean(gather), sent).groupBy("bucket").applyInArrow(count, sent)
    return counted.groupBy("block").applyInArrow(add, "doc_id long, n long, d1 long, d2 long, shared long")


def _sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(node, d1, d2, n, shingles) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = string_buffers(b.column(1))
            for i, j in chunks(off):
                sets = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                dig = digests(sets)
                cols = [b.column(0)[i:j], pa.array(dig[:, 0].view(np.int64)), pa.array(dig[:, 1].view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "d1", "d2", "n", "shingles"])

    return docs.mapInArrow(lean(run), "node long, d1 long, d2 long, n long, shingles array<long>")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (x, y) with nx, ny and the size of the overlap, those that may link by size."""
    a = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("shingles").alias("sx"))
    b = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("shingles").alias("sy"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "ny", F.size(F.array_intersect("sx", "sy")).cast("long").alias("both"))


def _links(c: str, percent: int) -> F.Column:
    return F.expr(f"100 * ({c}) >= {percent} * (nx + ny - ({c}))")


def join(docs: DataFrame, k: int = 5, percent: int = 75, buckets: int | None = None, connecting: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, members, links) of a self-join of (doc_id, text) by shingles.

    rows: (doc_id, n, d1, d2, shared) of each row. members: (d1, d2, n, node) for each set
    of more than one row or with a link: node is the smallest doc_id that has the set.
    links: (x, y, both), x < y, each pair of nodes with a similarity of percent / 100 or
    more once, with the size of the overlap. A group of m different near copies has up to
    m * (m - 1) / 2 of them; with `connecting`, a pair is left out where its ends are
    connected already, so that groups cost little where only components are asked for.
    Null texts and texts without words have no shingles and
    link with nothing, and so do rows with a null doc_id. Rows that share a doc_id count
    as one node, with the largest overlap of their texts. `buckets`, of which a task holds one
    at a time, default to eight for each of the session's shuffle partitions.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(measured(docs, k, buckets), "shingle-sets")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("shared").alias("shared"))
    members = written(classes.where(f"copies > 1 or 100 * shared >= {percent} * n"), "shingle-classes")
    able = members.where(f"100 * shared >= {percent} * n").select("d1", "d2", "node")
    ids = able.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = written(_sets_of(texts, k).join(able, ["node", "d1", "d2"], "left_semi").dropDuplicates(["node", "d1", "d2"]), "candidate-sets")
    # frequencies; a shingle of one set only stands first in its order and lists nothing
    parts = sets.select("node", "n", F.explode("shingles").alias("token"))
    often = parts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = parts.join(often, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    length = F.expr(f"cast(n - floor(({percent} * n + 99) / 100) + 1 - (n - size(tokens)) as int)")
    prefix = ordered.select("node", "n", F.slice("tokens", 1, F.greatest(length, F.lit(0))).alias("tokens"), (F.col("n") - F.size("tokens")).alias("alone"))
    index = written(prefix.select("node", "n", "alone", F.posexplode("tokens")).select("node", "n", F.col("col.token").alias("token"), F.col("col.df").alias("df"), (F.col("pos") + F.col("alone")).alias("at")), "prefix-index")
    # stars
    ends = index.groupBy("node").agg(F.max_by("token", "at").alias("common"), F.min_by("token", "at").alias("rare"))
    centre = index.groupBy("token").agg(F.min("node").alias("y"))
    wanted = ends.select(F.col("node").alias("x"), F.explode(F.array_distinct(F.array("common", "rare"))).alias("token"))
    stars = written(_overlaps(wanted.join(centre, "token").where("x <> y").select("x", "y").distinct(), sets).where(_links("both", percent)), "star-links")
    if connecting:  # only the lists that the stars leave in several parts, and pairs of two parts
        reached = components(stars, "x", "y").select("node", F.col("component").alias("part"))
        placed = index.join(reached, "node", "left").withColumn("part", F.coalesce("part", "node"))
        sizes = placed.groupBy("token", "part").agg(F.count("*").alias("m"))
        lists = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("m", "part")).alias("main")).where("parts > 1")
        apart, outside = "px <> py", "part <> main"
    else:
        placed = index.withColumn("part", F.col("node"))
        lists = index.groupBy("token").agg(F.count("*").alias("parts")).where("parts > 1")
        apart, outside = "px < py", "true"
    mixed = written(placed.join(lists, "token").withColumn("block", F.floor(F.col("at") / POSITIONS)), "mixed-lists")
    blocks = mixed.groupBy("token", "block").agg(F.max(F.col("n") - F.col("at")).alias("rest"), F.min("n").alias("least"), F.max("n").alias("most"))
    probes = mixed.where(outside).select("token", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("part").alias("px"))
    need = f"{percent} * (nx + {{}}) / {100 + percent}.0"
    near = probes.join(blocks, "token").where(f"100 * most >= {percent} * nx and {percent} * least <= 100 * nx and least(nx - ax, rest) >= {need.format('least')}")
    found = near.select("token", "block", "x", "nx", "ax", "px").join(mixed.select("token", "block", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("part").alias("py")), ["token", "block"])
    found = found.where(f"{apart} and 100 * least(nx, ny) >= {percent} * greatest(nx, ny) and least(nx - ax, ny - ay) >= {need.format('ny')}")
    pairs = found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    if not connecting:  # the stars have these
        pairs = pairs.join(stars.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_anti")
    pairs = written(pairs, "mixed-pairs")
    # bounds from the answers of y's centre
    known = stars.groupBy("x").agg(F.min_by(F.struct("y", "both"), "y").alias("s")).select(F.col("x").alias("y"), F.col("s.y").alias("r"), F.col("s.both").alias("yr"))
    through = pairs.join(known, "y")
    several = written(sets.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "ids-of-several-sets")
    for c in ("x", "y", "r"):  # the bounds are those of one set an id
        through = through.join(several.withColumnRenamed("node", c), c, "left_anti")
    through = through.select("x", "y", "r", "yr")
    asked = _overlaps(through.where("x <> r").select("x", F.col("r").alias("y")).distinct(), sets).select("x", F.col("y").alias("r"), F.col("both").alias("xr"), "nx")
    size = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"))
    barred = through.join(asked, ["x", "r"]).join(size, "y").where(~_links("least(nx, xr + ny - yr)", percent)).select("x", "y")
    rest = _overlaps(pairs.join(barred, ["x", "y"], "left_anti"), sets).where(_links("both", percent))
    links = stars.select(F.col("y").alias("x"), F.col("x").alias("y"), "both").union(rest.select("x", "y", "both"))
    links = written(links.groupBy("x", "y").agg(F.max("both").alias("both")), "jaccard-links")
    return rows, members.select("d1", "d2", "n", "node"), links


def near_groups(docs: DataFrame, k: int = 5, percent: int = 75, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id
    that links reach, the row's own included (its own without links). See join()."""
    rows, members, links = join(docs, k, percent, buckets, connecting=True)
    parts = components(links, "x", "y")
    of = members.join(parts, "node", "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
    return rows.join(of, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
