"""Mix sources to target weights by hash-threshold histograms.

Each source has a target number of words. Below its size, the documents whose hash lies under a
threshold are taken once; above it all are taken once and those under the threshold twice (the two
thresholds are nested, one of them is always at an end of the range). The threshold is found without
sorting: sum the words by (source, hash bucket), find the bucket in which the budget is used up, and
look into that bucket alone with the next bits, until it holds one hash. Then the nearer side wins, so a
source misses its target by half of its largest document at most.

Hashes come from the id, so reruns agree, and rows that repeat an id are taken or left together. A null
id hashes like an empty text, a null text has size 0, a null source is a source of its own. Sources of
size 0 get target 0. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.positions import unused
from strataweave.scratch import Scratch
from strataweave.skew import number_rows

BITS = 12
HASH_BITS = 60
SALTS = 16


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR; 0 for null."""
    # a word ends where a word character is followed by a blank or the end
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float, scratch: Scratch) -> DataFrame:
    """(key, source_size, target) for ``sizes(key, source, source_size)``.

    Sources in code point order, null last, weigh ``weights`` in rotation and share ``share`` times all
    words; no target exceeds ``most`` times its source, and what is over goes to the others by weight.
    """
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = scratch.save(
        ranked.select(
            "key", "source_size", F.get(turn, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight")
        )
    )
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.lit(most) * F.col("source_size")
    rate = float("inf")  # words for one unit of weight; falls as sources reach their cap
    capped = F.lit(False)
    known = -1
    while True:
        found = table.agg(
            F.sum(F.when(capped, cap)).alias("fixed"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if found.n == known or not found.weight:
            break
        known, rate = found.n, (budget - (found.fixed or 0.0)) / found.weight
        capped = F.lit(rate) * F.col("weight") > cap
    share_of = F.lit(rate) * F.col("weight")
    return table.select("key", "source_size", F.when(share_of > cap, cap).otherwise(share_of).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, source_size, target, base, cut): a document is taken base times, once more if hash < cut."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    open_ = goals.withColumn("base", base).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    open_ = scratch.save(open_.withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long")))
    closed, inside, shift = None, sized, HASH_BITS
    columns = ["key", "source_size", "target", "base", "cut"]
    while True:
        shift -= BITS
        histogram = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        histogram = scratch.save(histogram)  # at most 2 ** BITS rows a source
        upto = Window.partitionBy("key").orderBy("bucket")
        found = (
            histogram.withColumn("upto", F.sum("words").over(upto))
            .join(open_, "key")
            .where((F.col("before") + F.col("upto") > F.col("budget")) & (F.col("words") > 0))
            .groupBy(*open_.columns)
            .agg(F.min(F.struct("bucket", "upto", "words", "low", "high")).alias("b"))
            .withColumn("below", F.col("before") + F.col("b.upto") - F.col("b.words"))
        )
        found = scratch.save(found)
        nearer = (F.col("below") + F.col("b.words") - F.col("budget")) < (F.col("budget") - F.col("below"))
        cut = F.when(nearer, F.col("b.high") + 1).otherwise(F.col("b.low"))
        ready = found.where("b.low = b.high").withColumn("cut", cut).select(*columns)
        # sources without words, or whose budget is not exceeded by any bucket, take no second copy
        none = open_.join(found.select("key"), "key", "left_anti").withColumn("cut", F.lit(0).cast("long"))
        ready = ready.unionByName(none.select(*columns))
        closed = ready if closed is None else closed.unionByName(ready)
        wide = found.where("b.low < b.high")
        if wide.isEmpty():
            return closed
        open_ = scratch.save(
            wide.select(
                "key", "source_size", "target", "base", "budget", F.col("below").alias("before"),
                F.col("b.bucket").alias("prefix"),
            )
        )
        edge = open_.select("key", F.col("prefix").alias("bucket"))
        inside = scratch.save(
            inside.withColumn("bucket", F.shiftright("hash", shift)).join(edge, ["key", "bucket"], "left_semi")
        ).drop("bucket")


def mix(
    docs: DataFrame,
    weights: list[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """``docs`` with all its columns and size, source_size, target, taken.

    ``taken`` is the words that the mix takes of the document, repeats counted: 0, 1 or 2 times its size
    (more if ``most`` is larger). Columns of ``docs`` with these names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "llm-mix")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    sized = scratch.save(
        docs.select(
            key.alias("key"), "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")
        )
    )
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    goals = scratch.save(targets(sizes, list(weights), share, most, scratch))
    found = thresholds(sized.drop("source"), goals, scratch)
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    helpers: dict[str, str] = {}
    for name in ("key", "hash", "salt", "base", "cut"):
        helpers[name] = unused(f"_{name}", [*docs.columns, *helpers.values()])
    key_, hash_, salt_, base_, cut_ = helpers.values()
    # a source may hold a third of all rows: its documents are spread over the salts
    salted = scratch.save(
        found.withColumn(salt_, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed(
            {"key": key_, "base": base_, "cut": cut_}
        )
    )
    return (
        docs.select(*own)
        .withColumns({key_: key, hash_: id_hash(F.col("doc_id")), "size": word_count(F.col("text"))})
        .withColumn(salt_, F.pmod(hash_, F.lit(SALTS)).cast("int"))
        .join(salted, [key_, salt_])
        .withColumn("taken", F.col("size") * (F.col(base_) + F.when(F.col(hash_) < F.col(cut_), 1).otherwise(0)))
        .select(*own, "size", "source_size", "target", "taken")
    )
