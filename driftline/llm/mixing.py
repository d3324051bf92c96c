"""Mixing sources to target weights.

The words of each source, laid end to end, are packed into blocks of a fixed
length. Output shards hold a fixed number of slots; for each shard the numbers of
slots per source are drawn from a multinomial, and what a source got beyond its
quota over all shards is handed to the sources that fell short. Slot ``k`` of a
source is mapped by a pseudorandom permutation of the source's block indices
(swap-or-not, ROUNDS rounds) to a block, which is found by joining on its index.
The last slot of a source takes only the words that its target still lacks.

The words of a source lie in the order of hashes of whole rows, and rows that are
equal can stand for one another, so that everything is a function of the seed and
the rows: reruns agree, however the rows are partitioned. Everything is made of
DataFrame functions. The tables of sources and of shards are ordered in one task;
they have a row per source and per SLOTS_PER_SHARD blocks of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.llm.columns import let, running_start, words_of
from driftline.session import written

BLOCK = 64
SLOTS_PER_SHARD = 65_536
ROUNDS = 16
SEED = 20_011
CELLS = 4096


def permuted(index: Column, n: Column, stream: Column) -> Column:
    """A pseudorandom permutation of 0 to ``n - 1`` for each value of ``stream``."""

    def round_(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), stream, r), n) - x, n)
        swap = F.pmod(F.xxhash64(F.lit(SEED + 1), stream, r, F.greatest(x, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), round_)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source: its number, size, weight and target.

    Sources are numbered by code point, null last, and take the weights in turn.
    The targets share ``share`` times all sizes by weight but stop at ``cap``
    times the source's size; the excess is shared again by weight among the rest.
    That is the level at which water stands when each source is a vessel as wide
    as its weight and as large as its cap: fill in the order of cap / weight.
    """
    totals = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col(source).isNull(), F.col(source))) - 1
    table = totals.withColumn("number", number.cast("long"))
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    table = table.withColumn("__cap", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("__cap") / F.col("weight"), "number")
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(share) - before) / open_weight
    table = table.withColumn("__level", level)
    stands = F.max(F.when(F.col("__level") * F.col("weight") <= F.col("__cap"), F.col("__level"))).over(whole)
    target = F.least(F.col("__cap"), F.coalesce(stands * F.col("weight"), F.col("__cap")))
    return table.select(source, "number", "source_size", "weight", target.alias("target"))


def _quotas(targets: DataFrame) -> DataFrame:
    """Slots of each source: whole passes over its blocks, then ``rest`` words in the permuted order, the short block last."""
    words = F.round("target").cast("long")
    t = targets.where((F.col("source_size") > 0) & (words > 0)).select("number", "source_size", words.alias("words"))
    t = t.withColumns({"full": F.expr(f"source_size div {BLOCK}"), "blocks": F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}"), "passes": F.expr("words div source_size"), "rest": F.expr("words % source_size")})
    t = t.withColumn("partial", F.least(F.col("blocks"), F.expr(f"(rest + {BLOCK - 1}) div {BLOCK}")))
    return t.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("partial"))


def _counts(spark, quotas: DataFrame, all_slots: int) -> DataFrame:
    """Slots of each source in each shard: multinomial draws, brought to the quotas."""
    first = F.coalesce(F.sum("slots").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    width = -(-all_slots // CELLS)
    spans = quotas.select("number", "slots", first.alias("first"))
    cells = spans.select("number", "first", (F.col("first") + F.col("slots")).alias("end"), F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + slots - 1) div {width}"))).alias("cell"))
    draws = spark.range(all_slots).select(
        F.expr(f"id div {SLOTS_PER_SHARD}").alias("shard"),
        F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("id")), F.lit(all_slots)).alias("at"),
    )
    drawn = draws.withColumn("cell", F.expr(f"at div {width}")).join(cells, "cell").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("end")))
    drawn = written(drawn.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("n")), "draws")

    earlier = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    met = drawn.join(quotas.select("number", "slots"), "number")
    met = met.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.coalesce(F.sum("n").over(earlier), F.lit(0)))))

    def ranked(counts: DataFrame, key: str) -> DataFrame:
        start = F.coalesce(F.sum("over").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.where(F.col("over") > 0).select(key, "over", start.alias("start")).select(key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("over") - 1)).alias("rank"))

    spare = ranked(met.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("over")), "shard")
    held = met.groupBy("number").agg(F.sum("kept").alias("kept"))
    short = quotas.join(held, "number", "left").select("number", (F.col("slots") - F.coalesce("kept", F.lit(0))).alias("over"))
    moved = spare.join(ranked(short, "number"), "rank").groupBy("shard", "number").agg(F.count(F.lit(1)).alias("n"))
    both = met.select("shard", "number", F.col("kept").alias("n")).unionByName(moved.select("shard", "number", "n"))
    return both.groupBy("shard", "number").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def slot_table(targets: DataFrame) -> DataFrame:
    """The mix itself: a row for each slot with its ``shard``, source ``number``, ``draw`` (slot of the source), ``block`` and the first ``take`` words of the block."""
    spark = targets.sparkSession
    quotas = written(_quotas(targets), "quotas")
    all_slots = quotas.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if not all_slots:
        return spark.createDataFrame([], "shard long, number long, draw long, block long, take long")
    counts = _counts(spark, quotas, all_slots)
    start = F.coalesce(F.sum("n").over(Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # dealt out by number before they are multiplied: the few rows of counts would else meet in one task
    spread = counts.select("shard", "number", "n", start.alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "number")
    slots = spread.select("shard", "number", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("draw"))
    slots = slots.join(quotas, "number")
    slots = slots.withColumns({"__pass": F.expr("draw div blocks"), "__i": F.expr("draw % blocks")})
    block = F.when(F.col("__i") < F.col("full"), permuted(F.col("__i"), F.greatest(F.col("full"), F.lit(1)), F.col("number"))).otherwise(F.col("full"))
    in_block = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK)
    take = F.when(F.col("__pass") < F.col("passes"), in_block).otherwise(F.least(in_block, F.col("rest") - F.col("__i") * BLOCK))
    return slots.withColumn("block", block).select("shard", "number", "draw", "block", take.cast("long").alias("take"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """How much of every document the mix takes.

    Returns the columns of ``docs`` but ``text``, with ``row`` (a number that no
    other row has), ``size``, ``source_size``, ``target``, ``taken`` and
    ``pieces``: the runs of words that are taken, each with the place of its first
    word, the length, and the times the whole run (``whole``) and a beginning of
    it (``begin`` words, once more) are taken.

    Null and blank texts have size 0 and nothing is taken of them; a null source
    is a source like any other; equal rows are different documents. An empty
    table gives an empty result. Columns named like the result's are replaced.
    """
    added = ("row", "size", "number", "source_size", "target", "taken", "pieces")
    others = [c for c in docs.columns if c not in (*added, text)]
    sizes = docs.select(*others, F.size(words_of(F.col(text))).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"), *_content(docs.columns))
    return mix_rows(written(sizes, "sizes"), source, **how).drop("__h1", "__h2")


def _content(columns: list[str]) -> list[Column]:
    """Two hashes of a row's content, ``__h1`` and ``__h2``."""
    names = sorted(columns)
    return [F.xxhash64(F.lit(SEED + k), *names).alias(f"__h{k}") for k in (1, 2)]


def _starts(slim: DataFrame, buckets: int) -> DataFrame:
    """Add ``start``, the words of the source before a row, in the order of content.

    ``slim``: ``row``, ``number``, ``size``, ``__h1``, ``__h2``. The first hash deals
    rows into buckets; equal rows share one, and so that however many they are no
    task holds them all, they are dealt once more by a salt, which only says which of them
    comes first. Row totals are ordered within buckets, buckets within sources.
    """
    dealt = slim.withColumns({"__bucket": F.pmod("__h1", F.lit(buckets)), "__salt": F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(buckets))})
    keys = ["number", "__bucket", "__h1", "__h2", "__salt"]
    groups = dealt.groupBy(*keys).agg(F.sum("size").alias("__words"))
    placed = running_start(groups, ["number"], "__bucket", [F.col(k) for k in keys[2:]], "__words", "__first")
    local = F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__local", local).join(placed.drop("__words"), keys).withColumn("start", F.col("__first") + F.col("__local"))


def mix_rows(sized: DataFrame, source: str = "source", **how) -> DataFrame:
    """As ``mix``, from a written table that has ``size``, ``row`` and the content hashes already."""
    targets = written(source_targets(sized, source=source, **how), "targets")
    slots = slot_table(targets)
    whole = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK)
    takes = (
        slots.join(targets.select("number", "source_size"), "number")
        .groupBy("number", "block")
        .agg(F.count_if(F.col("take") == whole).alias("whole"), F.max(F.when(F.col("take") < whole, F.col("take")).otherwise(F.lit(0))).alias("cut"))
    )
    buckets = max(64, sized.count() // 5000 + 1)
    known = sized.join(targets.withColumnRenamed(source, "__source"), F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    placed = _starts(known.select("row", "number", "size", "__h1", "__h2").where("size > 0"), buckets)
    cut = placed.select("row", "number", "start", "size", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))
    pieces = cut.select("row", "number", "block", (F.col("block") * BLOCK + low - F.col("start")).alias("at"), low.alias("low"), high.alias("high"))
    found = pieces.join(takes, ["number", "block"]).withColumn("begin", F.greatest(F.lit(0), F.least(F.col("high"), F.col("cut")) - F.col("low")))
    per_row = found.groupBy("row").agg(
        F.sum(F.col("whole") * (F.col("high") - F.col("low")) + F.col("begin")).alias("taken"),
        F.array_sort(F.collect_list(F.struct("at", (F.col("high") - F.col("low")).alias("length"), "whole", "begin"))).alias("pieces"),
    )
    return known.drop("number", "weight").join(per_row, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document that the mix takes once or twice comes as one or two rows; where
    only some of its words are taken, the text holds these, joined by spaces.
    """
    names = docs.columns
    whole = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    sized = written(whole.select(F.col("__row").alias("row"), F.col(source).alias("__from"), F.size(words_of(F.col(text))).cast("long").alias("size"), *_content(names)), "sizes")
    taken = mix_rows(sized, "__from", **how).where(F.col("taken") > 0).select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.col("pieces").alias("__pieces"))

    def length(p: Column, turn: Column) -> Column:
        return F.when(p["whole"] >= turn, p["length"]).when(p["whole"] == turn - 1, p["begin"]).otherwise(F.lit(0))

    turns = F.explode(F.sequence(F.lit(1), F.lit(2)))
    rows = whole.join(taken, "__row").withColumn("__turn", turns)
    rows = rows.withColumn("__runs", F.filter(F.transform("__pieces", lambda p: F.struct(p["at"].alias("at"), length(p, F.col("__turn")).alias("n"))), lambda r: r["n"] > 0)).where(F.size("__runs") > 0)
    n = F.aggregate("__runs", F.lit(0).cast("long"), lambda s, r: s + r["n"])
    words = rows.withColumn("__n", n)
    # bound once: inside the inner function the text would be split again for each run
    some = let(words_of(F.col(text)), lambda w: F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(w, (r["at"] + 1).cast("int"), r["n"].cast("int")))), " "))
    new = words.withColumn(text, F.when(F.col("__n") == F.col("__size"), F.col(text)).otherwise(some))
    if "n_chars" in names:
        new = new.withColumn("n_chars", F.char_length(text).cast("long"))
    return new.select(*names)
