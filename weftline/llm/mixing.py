"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, merged, n_words, parts_for, table, text_or_empty, written

#: Weights of the sources in their order, repeating; share of all words that the mix has; most times that a source is taken.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words of a block, at most; rows of a chunk, the unit of prefix sums; slots of a chunk; seed of the shuffle.
BLOCK_WORDS, CHUNK_ROWS, CHUNK_SLOTS, SEED = 256, 4096, 8192, 7
#: Cells of [0, 1) by which slots meet the sources' intervals, at least; with more sources as many as sources.
CELLS = 1024
#: Columns that a mix adds; columns of these names in docs are replaced.
ADDED = ("size", "start", "source_size", "target", "taken")
#: One divided by the golden ratio.
GOLDEN = (math.sqrt(5) - 1) / 2


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """sizes: source, words. Adds position, weight, target, lo, hi: the source's part of [0, 1) by target.

    share of all words is dealt by weight; a target stops at passes times the source's words and the excess
    goes to the others by weight. That is target = min(passes * words, level * weight) with one level for
    all: with the sources ordered by words / weight, the level is that of the first source that it does not cap.
    A row per source, so the windows over all of them hold no more than that.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("position"), F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("position", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("cap", F.col("words") * F.lit(float(passes)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    before, after, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    df = df.withColumn("wanted", F.sum("words").over(every) * F.lit(float(share)))
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    df = df.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    df = df.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "position", "level"))).over(every)["level"])
    df = df.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    run = by_name.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(every)
    df = df.withColumn("hi", F.when(total > 0, F.sum("target").over(run) / total).otherwise(0.0)).withColumn("total_target", total)
    return df.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0))).select("source", "words", "position", "weight", "target", "total_target", "lo", "hi")


def place_of(seed: int, chunks: int) -> dict[str, Column]:
    """The place of a document (doc_id, size) in its source's stream: its chunk __wl_c, then its hash __wl_k, then its doc_id."""
    k = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    return {"__wl_k": k, "__wl_c": F.pmod(k, F.lit(chunks))}


def streams(sized: DataFrame, *, chunk_rows: int = CHUNK_ROWS, seed: int = SEED) -> DataFrame:
    """sized: doc_id, source, size and others. Adds start: the words of its source before it, in the order of a hash.

    A source's rows are dealt by hash into chunks, so a source with any share of the rows is spread; chunk
    sums give each chunk its first word and a window inside the chunk the rest. Rows equal in the whole order
    may swap places.
    """
    keyed = sized.withColumns(place_of(seed, parts_for(sized.count(), chunk_rows)))
    sums = keyed.groupBy("source", "__wl_c").agg(F.sum("size").alias("__wl_w"))
    before = Window.partitionBy("source").orderBy("__wl_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__wl_o", F.coalesce(F.sum("__wl_w").over(before), F.lit(0))).select(F.col("source").alias("__wl_s"), F.col("__wl_c").alias("__wl_d"), "__wl_o")
    inside = Window.partitionBy("source", "__wl_c").orderBy("__wl_k", F.col("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    met = keyed.withColumn("__wl_i", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("__wl_s")) & (F.col("__wl_c") == F.col("__wl_d")))
    return met.withColumn("start", F.col("__wl_o") + F.col("__wl_i")).drop("__wl_k", "__wl_c", "__wl_i", "__wl_s", "__wl_d", "__wl_o")


def dealt(plan: DataFrame, *, block_words: int = BLOCK_WORDS, passes: int = PASSES) -> DataFrame:
    """plan: rows of targets(). Adds blocks (equal ones, up to a word, of at most block_words words that make up the source),
    slots (blocks that the mix takes, repeats counted) and first (slots of the sources before it).

    A target under a block's words makes the source's blocks as small as the target, so that each source is taken to
    within half a block of its target, and a source with a target gets a slot at least.
    """
    words, target = F.col("words"), F.col("target")
    fit = F.least(words, F.round(words / target).cast("long"))
    df = plan.withColumn("blocks", F.greatest(F.ceil(words / F.lit(float(block_words))).cast("long"), F.when(target > 0, fit), F.lit(1)))
    slots = F.greatest(F.lit(1), F.least(F.col("blocks") * passes, F.round(target / words * F.col("blocks")).cast("long")))
    df = df.withColumn("slots", F.when(target > 0, slots).otherwise(F.lit(0)).cast("long"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))  # a row per source
    return df.withColumn("first", F.sum("slots").over(by_name) - F.col("slots"))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def block_start(block: Column, words: Column, blocks: Column) -> Column:
    """The first word of a block: floor(block * words / blocks), without a product of the words."""
    return block * div(words, blocks) + div(block * (words % blocks), blocks)


def block_of(word: Column, words: Column, blocks: Column) -> Column:
    """The block that holds a word; the quotient of doubles is one off at most."""
    near = F.floor(word / (words / blocks))
    return near + F.when(block_start(near, words, blocks) > word, -1).when(block_start(near + 1, words, blocks) <= word, 1).otherwise(0)


def schedule(plan: DataFrame, *, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """plan: rows of dealt(). The mix's slots in order: slot, source, block (of the source's shuffled words), pass_no (from 0).

    Of n slots, slot j's point is j * g modulo n; g is the number next to n divided by the golden ratio that has no divisor in
    common with n, so each number under n is the point of one slot. It falls in one source's interval, which is as
    long as the source has slots; the source's r-th slot takes its block r modulo the number of its blocks. Points meet
    intervals by equal cells, and ranks come from counts by chunk of slots, so no task holds all slots of a source.
    """
    spark = plan.sparkSession
    n = plan.agg(F.sum("slots")).first()[0] or 0
    step = next(g for g in range(max(1, round(n * GOLDEN)), 2 * n + 2) if math.gcd(g, n) == 1 or not n)
    cells = max(CELLS, plan.count())
    cell = lambda point: div(point * cells, F.lit(max(1, n)))
    ranges = plan.where("slots > 0").select(F.col("source").alias("__wl_s"), "first", "slots", "blocks", "position", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.col("slots") - 1))).alias("__wl_cell"))
    high, low = div(F.col("id"), F.lit(1 << 16)), F.col("id") % (1 << 16)  # products stay under 2^63
    points = spark.range(n).select(F.col("id").alias("slot"), ((high * step % max(1, n) * (1 << 16) + low * step) % max(1, n)).alias("u"))
    met = points.withColumn("__wl_cell", cell(F.col("u"))).join(ranges, "__wl_cell").where((F.col("u") >= F.col("first")) & (F.col("u") < F.col("first") + F.col("slots"))).drop("first").withColumn("__wl_j", F.expr(f"slot div {chunk_slots}"))
    counts = met.groupBy("position", "__wl_j").agg(F.count("*").alias("n"))
    before = Window.partitionBy("position").orderBy("__wl_j").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("position").alias("__wl_p"), F.col("__wl_j").alias("__wl_h"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("position", "__wl_j").orderBy("slot")) - 1
    ranked = met.withColumn("rank", rank).join(counts, (F.col("position") == F.col("__wl_p")) & (F.col("__wl_j") == F.col("__wl_h"))).withColumn("rank", F.col("rank") + F.col("first"))
    return ranked.select("slot", F.col("__wl_s").alias("source"), F.pmod("rank", "blocks").alias("block"), div(F.col("rank"), F.col("blocks")).alias("pass_no"))


def planned(sized: DataFrame, *, weights, share: float, passes: int, block_words: int) -> DataFrame:
    """sized: source, size. A row per source: words, target, blocks and slots; written."""
    return written(dealt(targets(sized.groupBy("source").agg(F.sum("size").alias("words")), weights=weights, share=share, passes=passes), block_words=block_words, passes=passes), "mix-targets")


def mix(docs: DataFrame, *, size: str | None = None, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of a mix that takes each source to its target.

    docs: doc_id, source, text, others are kept; size: a column that holds the number of words, in place of text. documents:
    docs with size (words; null text 0), source_size, start, target, taken (words that the mix takes, repeats counted); columns
    of docs with these names are replaced. pieces: the mix in order: slot, source, block, pass_no, doc_id, word_from, words; a
    block cuts documents, of any length, where it ends, as a token stream does. taken counts the words of the pieces. Sources by code point, null last as a source of its own; empty documents are
    never taken; repeated rows are different documents. Reruns agree. An empty table gives empty tables. Only DataFrame
    functions; texts move only if docs has them.
    """
    count = F.col(size).cast("long") if size else n_words(text_or_empty())
    sized = docs.select(*(c for c in docs.columns if c not in ADDED), count.alias("size"))
    plan = planned(sized, weights=weights, share=share, passes=passes, block_words=block_words)
    flow = streams(sized, seed=seed)
    mixed = pieces(flow, plan, schedule(plan))
    about = plan.select(F.col("source").alias("__wl_s"), F.col("words").alias("source_size"), "target")
    rows = flow.join(F.broadcast(about), F.col("source").eqNullSafe(F.col("__wl_s"))).drop("__wl_s")  # a row per source
    sums = mixed.groupBy(F.col("source").alias("__wl_s"), F.col("start").alias("__wl_at")).agg(F.sum("words").alias("taken"))
    here = F.when(F.col("size") > 0, F.col("start"))  # in a source no two documents with words start at one word
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__wl_s")) & (here == F.col("__wl_at")), "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("__wl_s", "__wl_at")
    return rows, mixed.drop("start")


def pieces(flow: DataFrame, plan: DataFrame, slots: DataFrame, *keep: str) -> DataFrame:
    """What each slot of the schedule takes of each document: slot, source, block, pass_no, doc_id, start (of the document in its source),
    word_from, words, and the columns of flow in keep. flow: rows of streams(), plan: of dealt(), slots: of schedule()."""
    words, blocks = F.col("__wl_w"), F.col("__wl_b")
    about = plan.select(F.col("source").alias("__wl_s"), F.col("words").alias("__wl_w"), F.col("blocks").alias("__wl_b"), F.col("slots").alias("__wl_n"))
    met = flow.where("size > 0").join(F.broadcast(about), F.col("source").eqNullSafe(F.col("__wl_s")))  # a row per source
    first, last = block_of(F.col("start"), words, blocks), F.least(block_of(F.col("start") + F.col("size") - 1, words, blocks), F.col("__wl_n") - 1)
    cut = met.select("doc_id", "source", *{"size": 0, "start": 0} | dict.fromkeys(keep, 0), "__wl_w", "__wl_b", first.alias("__wl_f"), last.alias("__wl_l")).where("__wl_f <= __wl_l")
    cut = cut.withColumn("block", F.explode(F.sequence("__wl_f", "__wl_l")))
    low, high = F.greatest(F.col("start"), block_start(F.col("block"), words, blocks)), F.least(F.col("start") + F.col("size"), block_start(F.col("block") + 1, words, blocks))
    cut = cut.select("doc_id", "source", "start", *keep, "block", (low - F.col("start")).alias("word_from"), (high - low).alias("words"))
    order = slots.select("slot", "pass_no", F.col("source").alias("__wl_s"), F.col("block").alias("__wl_b"))
    return cut.join(order, F.col("source").eqNullSafe(F.col("__wl_s")) & (F.col("block") == F.col("__wl_b"))).select("slot", "source", "block", "pass_no", "doc_id", "start", *keep, "word_from", "words")


def mixed_documents(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The pieces of the schedule's slots put together again, as rows of docs: in each pass of a source a document stands as often as
    its slots take all of its words (text as it is), or with just the first words that they take of it (n_chars, if docs has it, follows).

    A source's slots take its blocks in order, pass by pass, so a pass takes the start of a source's stream, and only of the document
    where the last one ends a part. Pieces hold no text; texts move once, by a hash of what places a document, to meet them. Rows that share
    doc_id, source and size are told apart by the hash of their text.
    """
    names = docs.columns
    key = ("__wl_x", "source", "doc_id", "size")
    hashed = F.xxhash64("source", "doc_id", "size")
    slim = written(docs.select("doc_id", "source", n_words(text_or_empty()).alias("size")), "mix-sizes")
    plan = planned(slim, weights=weights, share=share, passes=passes, block_words=block_words)
    flow = streams(slim, seed=seed).withColumn("__wl_r", F.row_number().over(Window.partitionBy("source", "doc_id", "size").orderBy("start")))
    cut = pieces(flow, plan, schedule(plan), "__wl_r", "size")
    each = cut.groupBy("source", "start", "doc_id", "size", "__wl_r", "pass_no").agg(F.sum("words").alias("n"))
    taken = each.select(hashed.alias("__wl_y"), F.col("source").alias("__wl_s"), F.col("doc_id").alias("__wl_d"), F.col("size").alias("__wl_n"), F.col("__wl_r").alias("__wl_q"), F.when(F.col("n") == F.col("size"), -1).otherwise(F.col("n")).alias("__wl_take"))
    rows = docs.select(F.struct(*names).alias("__wl_row"), "doc_id", "source", n_words(text_or_empty()).alias("size")).where("size > 0").withColumn("__wl_x", hashed).repartition("__wl_x")
    rows = rows.withColumn("__wl_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("__wl_row.text"))))
    same = (F.col("__wl_x") == F.col("__wl_y")) & F.col("source").eqNullSafe(F.col("__wl_s")) & F.col("doc_id").eqNullSafe(F.col("__wl_d")) & (F.col("size") == F.col("__wl_n")) & (F.col("__wl_r") == F.col("__wl_q"))
    rows = rows.join(taken, same).select("__wl_row.*", "__wl_take")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({SPACE}*{WORD})"), F.lit(1)), F.lit(1), F.col("__wl_take").cast("int")), "")
    out = rows.withColumn("text", F.when(F.col("__wl_take") < 0, F.col("text")).otherwise(head))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__wl_take") < 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(text_or_empty()).alias("words"))
    rows, _ = mix(written(merged(docs), "mix-sizes"), size="words")
    return rows.select("doc_id", "size", "source_size", "target", "taken")
