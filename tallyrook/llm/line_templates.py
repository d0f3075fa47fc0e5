"""Line dedup by log templates, in DataFrame operations only.

A fixed-depth tree: the first level is a line's number of tokens, the next levels are its
leading tokens (tokens with digits are variable fields, <*>). In a leaf, a token's support
is the number of documents that have it at its position. A line makes one template for
each level of support, min_docs * 2^k, that its tokens reach: those with at least this
support are constants, others are generalised to <*>. So a common value of a field is a
constant at low levels only, however large the corpus is, and rare templates are found at
low levels beside frequent ones. A line with enough constants at a level belongs to that
template. Templates that recur in `min_docs` documents or more are dropped from all
documents but the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, written

# Fixed value: the sign of a variable field.
FIELD = "<*>"


def _plain(line: Column) -> Column:
    """The line's tokens joined by single spaces. Only what differs is replaced: most lines
    have nothing but single spaces."""
    return F.trim(F.regexp_replace(line, r"[\x09-\x0D]+ *| {2,}", " "))


def _masked(plain: Column) -> Column:
    """Tokens with digits as variable fields."""
    return F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)


def _lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(__row, doc, at, plain, leaf) of each line with min_tokens tokens or more. Each step is
    done once a line, inside the array; behind the explode it would be done again for
    every filter and key that uses it."""
    plain = F.transform(F.split("text", "\n"), _plain)
    tokens = lambda s: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1
    keyed = F.transform(plain, lambda s: F.struct(s.alias("plain"), tokens(s).alias("n"), _masked(F.substring_index(s, " ", depth)).alias("lead")))
    rows = docs.select("__row", F.col("doc_id").alias("doc"), F.posexplode(keyed).alias("at", "line")).where(F.col("line.n") >= min_tokens)
    return rows.select("__row", "doc", "at", F.col("line.plain").alias("plain"), F.xxhash64("line.n", "line.lead").alias("leaf"))


def dropped_lines(docs: DataFrame, min_docs: int = 3, depth: int = 3, constant_share: float = 0.5, min_tokens: int = 4) -> DataFrame:
    """(__row, doc, __drop): for rows (__row, doc_id, text), the places (from 0) of lines to drop.

    A first pass counts leaves; only lines of leaves that several documents share are
    looked at further, and equal masked lines of these count as one with a weight. Where a
    document has several kinds of line in a leaf, its tokens count once. Sums over positions
    replace any gathering of a template's lines, so that a template may hold a third of all
    lines. A line goes if it is not in the first document of any one of its templates.
    """
    lines = _lines(docs, depth, min_tokens)
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b")).where(f"n >= {min_docs} and a <> b").select("leaf")
    leaves = written(leaves, "template-leaves")  # apart from the join, whose hot leaves adaptive execution can split then
    kept = written(lines.join(leaves.hint("shuffle_hash"), "leaf").select("__row", "doc", "at", "leaf", _masked(F.col("plain")).alias("masked")), "template-lines")
    kept = kept.withColumn("kind", F.xxhash64("leaf", "masked"))
    # one row for each kind of line, with the number of the documents that have no other in its leaf
    per_doc = kept.groupBy("leaf", "doc", "kind").agg(F.lit(1).alias("one")).groupBy("leaf", "doc").agg(F.collect_list("kind").alias("kinds"))
    per_doc = written(per_doc, "template-documents")
    alone = per_doc.where("size(kinds) = 1").groupBy(F.col("kinds")[0].alias("kind")).agg(F.count("*").alias("docs"))
    kinds = written(kept.groupBy("kind", "leaf", "masked").agg(F.lit(1).alias("one")).drop("one").join(alone, "kind", "left"), "template-kinds")
    tokens = kinds.select("kind", "leaf", "docs", F.posexplode(F.split("masked", " ")).alias("p", "token")).where(F.col("token") != FIELD)
    several = per_doc.where("size(kinds) > 1").select("leaf", "doc", F.explode("kinds").alias("kind"))
    once = several.join(tokens.select("kind", "p", "token"), "kind").groupBy("leaf", "doc", "p", "token").agg(F.lit(1).alias("one"))
    counted = tokens.where("docs is not null").select("leaf", "p", "token", "docs").union(once.select("leaf", "p", "token", F.lit(1).cast("long")))
    constant = counted.groupBy("leaf", "p", "token").agg(F.sum("docs").alias("support")).where(f"support >= {min_docs}")
    # levels of 2: the highest k with min_docs * 2^k <= support
    level = F.length(F.bin(F.floor(F.col("support") / min_docs))).alias("level")
    marked = tokens.join(constant, ["leaf", "p", "token"]).select("kind", "leaf", F.struct(level, F.xxhash64("p", "token").alias("hash")).alias("c"))
    length = kinds.select("kind", F.size(F.split("masked", " ")).alias("n"))
    lined = marked.groupBy("kind", "leaf").agg(F.collect_list("c").alias("c")).join(length, "kind").where(f"size(c) >= {constant_share} * n")
    at_level = lambda x: F.filter("c", lambda c: c["level"] >= x)
    shape = lambda x: F.struct(F.aggregate(at_level(x), F.lit(0).cast("long"), lambda h, c: h.bitwiseXOR(c["hash"])).alias("shape"), F.size(at_level(x)).alias("constants"))
    templates = lined.select("kind", "leaf", "n", F.explode(F.transform(F.array_distinct(F.transform("c", lambda c: c["level"])), shape)).alias("t")).select("kind", "leaf", "n", "t.*").where(f"constants >= {constant_share} * n")
    template = F.xxhash64("leaf", "n", "shape", "constants").alias("template")
    named = kept.join(templates.select("kind", template), "kind").select("__row", "doc", "at", "template")
    seen = named.groupBy("template", "doc").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("doc").alias("docs"), F.min("doc").alias("first")).where(f"docs >= {min_docs}")
    first = written(seen.select("template", "first"), "template-firsts")  # so that the join's hot templates can be split
    gone = named.join(first, "template").where(~F.col("doc").eqNullSafe(F.col("first")))
    return gone.groupBy("__row", "doc").agg(F.collect_set("at").alias("__drop"))


def drop_templates(docs: DataFrame, min_docs: int = 3, depth: int = 3, constant_share: float = 0.5, min_tokens: int = 4, report: str | None = None) -> DataFrame:
    """docs with the lines of recurring templates taken out of text (see dropped_lines).

    The first document of a template (by doc_id, nulls last) keeps its lines, so that of
    copies of a document one stays whole; a document whose lines all go has an empty
    text. Null texts stay null. Equal rows are treated alike. Columns and their order
    stay, whatever their names; with `report`, that column is added: the places of the dropped lines.
    """
    text = F.col("text").cast("string")
    row = F.xxhash64(F.col("doc_id"), F.lit("|"), text)
    lines = docs.select(row.alias("__row"), F.col("doc_id"), text.alias("text"))
    gone = dropped_lines(lines, min_docs, depth, constant_share, min_tokens)
    own, other, of, drop = free(docs.columns, "row", "line_row", "line_doc", "drop")
    gone = gone.select(F.col("__row").alias(other), F.col("doc").alias(of), F.col("__drop").alias(drop))
    joined = docs.withColumn(own, row).join(gone.hint("shuffle_hash"), (F.col(own) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(of)), "left")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    columns = [F.when(F.col(drop).isNull(), text).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if report:
        columns.append(F.sort_array(F.coalesce(F.col(drop), F.array().cast("array<int>"))).alias(report))
    return joined.select(*columns)
