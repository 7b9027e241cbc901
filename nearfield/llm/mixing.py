"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a random key that is a hash of its id and text, so that reruns agree. A source's documents are taken
in the order of their keys until its budget of words is met exactly: whole epochs first, then documents up to a cut, of
which the last gives only the words still missing. The order is never gathered in one place: sizes are summed by range
of keys, a prefix sum over those ranges names the range with the cut, and only that range (a few thousandths of a
source) is sorted by key. What is left is one row a source, and a document's share follows from comparing its key with
its source's cut. A source that holds a third of all rows is therefore spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import n_words, settle

#: Ranges of keys a source is split into.
RANGE_BITS = 12


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _order(h: Column) -> Column:
    """Unsigned order of the key's top bits."""
    return F.shiftrightunsigned(h, 64 - RANGE_BITS)


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) -> with weight and target: shares of all words by weight, at most ``most`` times a source.

    What is above a source's limit is shared again by weight among the others until none is above. In closed form: with
    sources by limit / weight, the first k are full, and the rest get level * weight for the level at which all is
    given out. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", k).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("ratio", F.col("limit") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("full", F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))).over(everything))
    )
    return t.select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level.level_here") * F.col("weight"))).alias("target"))


def plan(keyed: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """From (doc_id, source, size, h): one row a source with target, epochs and the cut (cut_h, cut_id, cut_left, cut_size)."""
    parts = settle(keyed.groupBy("source", _order(F.col("h")).alias("part")).agg(F.sum("size").alias("part_size")))
    budget = settle(
        targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most)
        .withColumn("whole", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("whole") - F.col("epochs") * F.col("source_size"))
    )
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    where = (
        parts.withColumn("before", F.coalesce(F.sum("part_size").over(upto), F.lit(0)))
        .join(budget.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("part_size")))
        .select("s", "part", "before", "rest")
    )
    where = settle(where)
    in_part = keyed.join(where, F.col("source").eqNullSafe(F.col("s")) & (_order(F.col("h")) == F.col("part")))
    by_key = Window.partitionBy("s").orderBy(F.col("h").asc(), F.col("doc_id").asc_nulls_first())
    cut = (
        in_part.groupBy("s", "h", "doc_id", "before", "rest")
        .agg(F.sum("size").alias("cut_size"))
        .withColumn("upto", F.col("before") + F.coalesce(F.sum("cut_size").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where((F.col("upto") <= F.col("rest")) & (F.col("rest") < F.col("upto") + F.col("cut_size")))
        .select("s", F.col("h").alias("cut_h"), F.col("doc_id").alias("cut_id"), (F.col("rest") - F.col("upto")).alias("cut_left"), "cut_size")
    )
    return settle(budget.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("cut_source"), "source_size", "target", "epochs", "cut_h", "cut_id", "cut_left", "cut_size"))


def _taken(size: Column, h: Column, doc_id: Column) -> Column:
    """Words that the mix takes of a document, against its source's cut. Equal keys share what is left at the cut."""
    part, cut_part = _order(h), _order(F.col("cut_h"))
    id_before = (doc_id.isNull() & F.col("cut_id").isNotNull()) | (doc_id < F.col("cut_id"))
    before = (part < cut_part) | ((part == cut_part) & ((h < F.col("cut_h")) | ((h == F.col("cut_h")) & F.coalesce(id_before, F.lit(False)))))
    at = (h == F.col("cut_h")) & doc_id.eqNullSafe(F.col("cut_id"))
    more = F.when(F.col("cut_h").isNull(), F.lit(0)).when(at, F.floor(size * F.col("cut_left") / F.col("cut_size"))).when(before, size).otherwise(F.lit(0))
    return (F.col("epochs") * size + more).cast("long")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key(seed).alias("h"))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    Sources by code point, null last, have the weights in turn. Null or empty texts have size 0 and give nothing; null is
    a source of its own; a source without words has target 0; rows that repeat (same id and text) share what the cut
    leaves, rounded down; an empty table gives no rows. Other columns are not read.
    """
    keyed = settle(_keyed(docs, seed))
    cuts = plan(keyed, weights, most)
    return keyed.join(cuts, F.col("source").eqNullSafe(F.col("cut_source"))).select(
        "doc_id", "size", "source_size", "target", _taken(F.col("size"), F.col("h"), F.col("doc_id")).alias("taken")
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each epoch of a document.

    Of the one document of each source at which the budget ends, the last row holds only the words still missing;
    n_chars, where present, follows the text. Texts stay where they are: only (id, source, size, key) is shuffled.
    """
    cuts = plan(settle(_keyed(docs, seed)), weights, most)
    names = docs.columns
    ours = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), n_words(F.col("text")).alias("size"), _key(seed).alias("h"))
    got = ours.join(cuts, F.col("source").eqNullSafe(F.col("cut_source"))).select("r", "size", _taken(F.col("size"), F.col("h"), F.col("doc_id")).alias("taken")).where("taken > 0")
    whole, left = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(left > 0, F.array(left)).otherwise(F.expr("array()").cast("array<long>")))
    rows = got.select("r", F.explode(copies).alias("part"))
    pieces = F.split(F.col("r.text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # words with the space after them
    part_of = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int") + F.col("r.text").rlike(r"^[\x20\x09-\x0D]").cast("int")), "")
    text = F.when(F.col("part") < 0, F.col("r.text")).otherwise(part_of)
    rows = rows.withColumn("t", text)
    kept = {c: F.col("r").getField(c) for c in names}
    kept["text"] = F.col("t")
    if "n_chars" in names:
        kept["n_chars"] = F.when(F.col("part") < 0, F.col("r.n_chars")).otherwise(F.length("t").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[kept[c].alias(c) for c in names])
