"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

1. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share `share` times all
   words. A target stops at `most` times its source's size; the excess goes to the others by weight.
2. A source's documents are shuffled (by a hash of the id) into one stream of words, cut into
   blocks of `block_words`. Its slots take the blocks in order, pass after pass, until the target.
3. Golden-ratio points k * phi mod 1 fall into the sources' shares of the unit interval; the r-th
   point in a source's share is the place of its r-th slot. Slots that no point fell to
   come at the end (the sequence's discrepancy leaves a few).

Running sums go by chunks: sums of chunks first, then inside a chunk, so that no
window holds more than a chunk's rows or a source's chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textward.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 4096
CHUNK_ROWS = 512
WORD = r"[^\x20\x09-\x0D]+"
PHI = (math.sqrt(5) - 1) / 2
_CELLS = 1024
#: Bytes of documents that a partition of the mix holds, roughly.
PART_BYTES = 128 << 20


def running(df: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """df with the sum of value over the rows before in order, within keys; needs a column `chunk`,
    the first of the order."""
    df = df.withColumn("_v", value)
    chunks = df.groupBy(*keys, "chunk").agg(F.sum("_v").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(chunks.hint("merge"), [*keys, "chunk"])  # grows with df
    return df.withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_base")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, src, source_size, target) for the sources of (source, size); src numbers them from 0."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    sums = sums.withColumn("src", n).withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # sources that reach their cap first stand first; the level is the words a unit of weight gets
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(share) * F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sums = sums.withColumn("level", (total - capped) / open_weight).withColumn("ok", F.col("level") <= F.col("cap") / F.col("w"))
    level = F.min(F.when(F.col("ok"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("src").alias("s"), F.col("level").alias("l")))).over(everything)
    return sums.withColumn("best", level["l"]).select(
        "source", "src", "source_size", F.coalesce(F.least("cap", F.col("best") * F.col("w")), F.col("cap")).alias("target")
    )


def slots(sources: DataFrame, block_words: int, scratch: Scratch) -> DataFrame:
    """(slot, src, pass, block, length): which block stands at each place of the mix, and how many of its words."""
    need = F.round("target").cast("long")
    plan = sources.where("source_size > 0").select("src", "source_size", "target", F.least(need, F.lit(MOST) * F.col("source_size")).alias("need"))
    size = lambda words: F.ceil(words / F.lit(block_words)).cast("long")
    full = F.floor(F.col("need") / F.col("source_size")).cast("long")
    rest = F.col("need") - full * F.col("source_size")
    plan = plan.withColumn("blocks", size(F.col("source_size"))).withColumn("n", full * F.col("blocks") + size(rest)).where("n > 0")
    # shares of the unit interval, cut at cells so that points find theirs by an equal join
    order = Window.orderBy("src")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = plan.withColumn("total", F.sum("n").over(whole)).withColumn("high", F.sum("n").over(order) / F.col("total"))
    plan = scratch.keep(plan.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))), "plan")
    cells = F.sequence(F.floor(F.col("low") * _CELLS), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS - 1)))
    cut = plan.select("src", "low", "high", F.explode(cells).alias("cell"))
    total = plan.agg(F.max("total").alias("t")).first().t or 0
    points = sources.sparkSession.range(total).withColumnRenamed("id", "slot")
    points = points.withColumn("x", F.col("slot") * F.lit(PHI) - F.floor(F.col("slot") * F.lit(PHI)))
    points = points.withColumn("cell", F.floor(F.col("x") * _CELLS))
    drawn = points.join(cut, "cell").where("x >= low and x < high").select("slot", "src", F.floor(F.col("slot") / CHUNK_ROWS).alias("chunk"))
    drawn = scratch.keep(running(drawn, ["src"], ["slot"], F.lit(1), "rank").select("slot", "src", "rank"), "drawn")
    got = drawn.groupBy("src").agg(F.count(F.lit(1)).alias("got"))
    late = plan.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < n")
    late = late.select((F.lit(total) + F.col("src")).alias("slot"), "src", F.explode(F.sequence(F.col("got"), F.col("n") - 1)).alias("rank"))
    ranked = drawn.union(late).join(plan, "src").where("rank < n")
    ranked = ranked.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    left = F.least(F.col("source_size") - F.col("block") * block_words, F.col("need") - F.col("pass") * F.col("source_size") - F.col("block") * block_words)
    return ranked.select("slot", "src", "pass", "block", F.least(F.lit(block_words).cast("long"), left).alias("length"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count.alias("size"), row.alias("row"))


class Mix:
    """The mix of docs: `sources` (targets), `pieces` (documents' words in blocks) and `schedule` (slots)."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> None:
        self.scratch = Scratch(docs.sparkSession, "mix")
        self.block_words = block_words
        rows = self.scratch.keep(sized(docs, id_col, text_col, source_col), "sized")
        self.sources = self.scratch.keep(targets(rows), "sources")
        chunks = max(1, math.ceil(rows.count() / CHUNK_ROWS))
        rows = rows.join(self.sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        place = F.xxhash64(F.col("doc_id"), F.lit(20))
        rows = rows.withColumn("place", place).withColumn("chunk", F.pmod(F.col("place"), F.lit(chunks)))
        rows = running(rows, ["src"], ["place", "doc_id", "size", "row"], F.col("size"), "start")
        self.rows = self.scratch.keep(rows.select("doc_id", "src", "source", "size", "row", "source_size", "target", "start"), "rows")
        self.schedule = self.scratch.keep(slots(self.sources, block_words, self.scratch), "slots")

    @property
    def pieces(self) -> DataFrame:
        """(doc_id, src, start, block, first, last): the part of each block that a document's words fill."""
        b = self.block_words
        blocks = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))
        cut = self.rows.where("size > 0").select("doc_id", "src", "start", "size", F.explode(blocks).alias("block"))
        first = F.greatest(F.col("start") - F.col("block") * b, F.lit(0))
        last = F.least(F.col("start") + F.col("size") - F.col("block") * b, F.lit(b))
        return cut.select("doc_id", "src", "start", "block", first.alias("first"), last.alias("last"))

    @property
    def words(self) -> DataFrame:
        """(slot, pass, doc_id, src, start, block, first, n): the words of documents that each slot takes."""
        n = F.least("last", "length") - F.col("first")
        return self.pieces.join(self.schedule.hint("merge"), ["src", "block"]).select("slot", "pass", "doc_id", "src", "start", "block", "first", n.alias("n")).where("n > 0")

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) for every row of docs."""
        sums = self.words.groupBy("src", "start").agg(F.sum("n").alias("taken"))
        some = self.rows.where("size > 0").join(sums.hint("merge"), ["src", "start"], "left")
        none = self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
        return some.select(*columns).union(none.select(*columns))

    def places(self) -> DataFrame:
        """(row, rows, places) for each kind of row taken: how many rows of it there are, and where the mix has them, ascending.

        A pass over the source takes a document where it takes at least half of its words; its place (slot, first) is that of
        its first word.
        """
        order = F.min(F.struct("slot", "first")).alias("place")
        taken = self.words.groupBy("src", "start", "pass").agg(F.sum("n").alias("n"), order)
        some = self.rows.where("size > 0").join(taken.hint("merge"), ["src", "start"], "left")
        place = F.when(2 * F.col("n") >= F.col("size"), F.col("place"))
        kinds = some.groupBy("row").agg(F.count_distinct("src", "start").alias("rows"), F.sort_array(F.collect_list(place)).alias("places"))
        return kinds.where(F.size("places") > 0)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs.

    size: words (runs other than space and \\x09-\\x0D) of the text, 0 if null; taken: words that the
    mix takes of the document, repeats counted, at most twice its size.  Sources include null;
    rows that repeat an id are mixed each for itself.  Without any words all targets are 0.
    """
    return Mix(docs, **options).taken()


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs in the order of the mix: partition by partition, and inside each, by slot and place in the slot's block.

    A row stands as often (0, 1 or 2 times) as passes over its source take at least half of its words; it stays
    whole, at the place of its first word. Rows without words are left out. Rows alike in id, source and text share
    their places. Columns may have any names; an empty table stays empty.
    """
    mix = Mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    spark = docs.sparkSession
    last = mix.schedule.agg(F.max("slot").alias("s")).first().s or 0
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts if size >= 1 << 60 else max(parts, size // PART_BYTES)
    key = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("row")
    found = docs.select(F.struct("*").alias("doc"), key).join(mix.places().hint("merge"), "row")
    # the rows of a kind stand in one partition already; each takes its part of the places
    number = F.row_number().over(Window.partitionBy("row").orderBy("row")) - 1
    own = F.filter("places", lambda _, k: F.pmod(k, F.col("rows")) == F.col("number"))
    each = found.withColumn("number", number).select("doc", F.explode(own).alias("place"))
    part = F.least(F.floor(F.col("place.slot") * parts / F.lit(last + 1)), F.lit(parts - 1)).cast("int")
    return each.repartitionById(parts, part).sortWithinPartitions("place").select("doc.*")
