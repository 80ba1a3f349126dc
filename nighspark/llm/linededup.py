"""Line dedup by a log-template tree, in DataFrame functions only.

A line's place in the tree is fixed by its number of tokens and its leading tokens (tokens holding a digit count as
the field <*>). Within a leaf a token is kept if at least `min_docs` documents have it there at that position, and is
else a field <*>; what results is the line's template. A template with enough constant tokens that recurs in at least
`min_docs` documents is dropped from all of them but the first (smallest id), which keeps its lines.

Only narrow rows travel: a first pass counts leaves; lines go on only from leaves with enough rows; equal lines are
counted before they are shuffled; a document's text meets its dropped positions in one join by document.

Defined cases: a null text stays null and an empty one empty, with no lines; blank lines are never dropped; a document
repeated in id and text is one document (all of its copies keep or lose the same lines); an empty table gives no rows;
lines of any length are taken whole; the smallest id, then the smallest hash of the row, decides who keeps a template; a
column named as n_dropped gives way to it, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nighspark.llm.common import maybe_broadcast, written

FIELD = "<*>"
DEPTH, MIN_DOCS, MIN_CONSTANT = 3, 10, 0.7
_KEY, _DROP = "__ns_row", "__ns_drop"


def _row_key(doc_id: str, text: str) -> Column:
    """Identity of a document: hash of id and text that tells nulls apart."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def _flat(line: Column) -> Column:
    return F.trim(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))


def _masked(flat: Column) -> Column:
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(flat)


def _lines(df: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    """row (document), id, pos, m (masked line), n (tokens), leaf (hash of the fixed-depth path)."""
    at = df.where(F.col(text).isNotNull()).select(_row_key(doc_id, text).alias("row"), F.col(doc_id).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    at = at.withColumn("flat", _flat(F.col("line"))).where("flat <> ''").select("row", "id", "pos", _masked(F.col("flat")).alias("m"))
    n = F.octet_length("m") - F.octet_length(F.replace("m", F.lit(" "), F.lit(""))) + 1
    return at.select("row", "id", "pos", "m", n.alias("n"), F.xxhash64(n, F.substring_index("m", " ", depth)).alias("leaf"))


def dropped_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """(row, drop): sorted positions (from 0) of the lines to drop, for documents that lose any."""
    lines = _lines(df, doc_id, text, depth)
    leaves = written(lines.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") >= min_docs).select("leaf"), "leaves")
    hot = lines.join(maybe_broadcast(leaves, leaves.count()), "leaf", "left_semi")
    # one row per document and distinct masked line; equal lines of all documents are then summed before their shuffle
    held = written(
        hot.withColumn("form", F.xxhash64("m")).groupBy("leaf", "form", "row").agg(F.min("id").alias("id"), F.collect_list("pos").alias("at"), F.first("m").alias("m")), "lines"
    )
    forms = held.groupBy("leaf", "form").agg(F.count("*").alias("docs"), F.min("m").alias("m"))
    tokens = forms.select("leaf", "form", "docs", F.posexplode(F.split("m", " ", -1)).alias("i", "token"))
    seen = tokens.groupBy("leaf", "i", "token").agg(F.sum("docs").alias("support"))
    kept = tokens.join(seen, ["leaf", "i", "token"]).select("leaf", "form", "i", F.when((F.col("support") >= min_docs) & (F.col("token") != FIELD), F.col("token")).alias("t"))
    shape = kept.groupBy("leaf", "form").agg(F.count("*").alias("n"), F.count("t").alias("constant"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("t", F.lit(FIELD)).alias("t")))).alias("p"))
    shape = shape.where(F.col("constant") >= F.col("n") * min_constant).select("leaf", "form", F.xxhash64("leaf", "p").alias("template"))
    shape = written(shape, "shapes")
    of = held.select("leaf", "form", "row", "id", "at").join(maybe_broadcast(shape, shape.count(), 200_000), ["leaf", "form"])
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    per = of.groupBy("template", "row").agg(F.min("id").alias("id"))
    recurring = written(per.groupBy("template").agg(F.count("*").alias("docs"), F.min(order).alias("first")).where(F.col("docs") >= min_docs).select("template", F.col("first.row").alias("keeper")), "templates")
    gone = of.join(maybe_broadcast(recurring, recurring.count(), 200_000), "template").where("row <> keeper")
    return gone.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("drop"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_dropped: str | None = None, **how) -> DataFrame:
    """df with recurring templates cut out of its text; with n_dropped, also their number per document."""
    gone = dropped_lines(df, doc_id, text, **how).select(F.col("row").alias(_KEY), F.col("drop").alias(_DROP))
    out = df.withColumn(_KEY, _row_key(doc_id, text)).join(gone, _KEY, "left")
    lines = F.split(F.col(text), "\n")
    # positions to keep, then their lines: one pass over each, however many lines a text has
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(_DROP))
    rest = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    out = out.withColumn("__ns_text", F.when(F.col(_DROP).isNull(), F.col(text)).otherwise(rest))
    names = [F.col("__ns_text").alias(text) if c == text else F.col(f"`{c}`") for c in df.columns if c != n_dropped]
    return out.select(*names, *([F.coalesce(F.size(_DROP), F.lit(0)).cast("long").alias(n_dropped)] if n_dropped else []))
