"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers ``<num>``, capitalised words inside a sentence ``<name>``, units ``<unit>``,
other words their lower-case form without punctuation at the ends. Windows of five template tokens are hashed and
joined with the windows of all benchmark items. An item leaks into a document if at least 80 % of its distinct
windows are found there, counting only alignments (document position minus item position) in which every slot
value of the item is replaced by one and the same value throughout: so a question that was re-parameterised is
found, and a table full of unrelated numbers is not. Several alignments, as left by words that were put in or left
out, count together if they replace each value by the same one, that with most windows; each also counts alone.

A word that starts a sentence or an item may be a name or not, and so may a capitalised one that starts a document's
sentence: windows are indexed under both readings. A window that needs ``<name>`` for such a word counts only if all
its slots, such words included, have one value throughout the alignment.

Everything is DataFrame functions. The benchmark side is broadcast only if its counted windows are few enough;
beyond that the join is shuffled. Window rows carry an id, a position and a hash, no text.

Nulls and ties: null texts have no words; items with fewer than five words are one window of their own length,
which must match word for word if it is placeholders only; items without words leak nowhere; items with equal text leak together. Every row is compared on its own, by a row number that is written
once. ``judge`` gives rows that repeat an id, other than null, the items of all of them; ``drop_leaks`` drops rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.positions import unused
from strataweave.scratch import Scratch

WINDOW = 5
SHARE = 0.8
BROADCAST_WINDOWS = 500_000  # three longs each
BLANK = r"[\x20\x09-\x0D]+"
PUNCTUATION = ".,;:!?\"'()[]{}"
UNITS = [
    "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "hour", "hours", "minute", "minutes",
    "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters",
    "metre", "metres", "kilometer", "kilometers", "gram", "grams", "liter", "liters", "litre", "litres", "inch",
    "inches", "foot", "feet", "mile", "miles", "pound", "pounds", "dollar", "dollars", "euro", "euros", "cent",
    "cents", "percent", "km/h", "mph", "%", "$", "kw", "kwh",
]


def words(text: Column) -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def tokenized(table: DataFrame, key: str) -> DataFrame:
    """(key, words): the words of ``table(key, text)`` as they are."""
    return table.select(key, words(F.col("text")).alias("words"))


def _plain() -> Column:
    return F.transform("words", lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)))


def _number(plain: Column) -> Column:
    first = F.ascii(plain)
    signed = first.isin(36, 43, 45, 163, 8364) & plain.rlike(r"^[^\p{L}\d]*\d")  # $ + - pound and euro signs
    return first.between(48, 57) | signed


def _capital(at: Column) -> Column:
    word = F.get(F.col("words"), at)
    return F.ascii(word) != F.ascii(F.lower(word))


def _starts(at: Column) -> Column:
    """Whether a word is the first, or follows the end of a sentence."""
    return (at == 0) | F.substring(F.get(F.col("words"), at - 1), -1, 1).isin(".", "!", "?", ":")


def _token(plain: Column, at: Column, number: Column, name: Column, unit: Column, other: Column, doubt) -> Column:
    """The template token of a word; ``doubt`` gets tokens of words that may be names besides."""
    rest = F.when(plain.isin(UNITS), unit).otherwise(other)
    return F.when(_number(plain), number).when(_starts(at), doubt(rest)).when(_capital(at), name).otherwise(rest)


def template() -> Column:
    """The template tokens of the column ``words``."""
    slots = [F.lit(x) for x in ("<num>", "<name>", "<unit>")]
    return F.transform(_plain(), lambda p, at: _token(p, at, *slots, p, lambda rest: rest))


def doubts(item: bool) -> Column:
    """Whether each word may be a name besides what ``template`` says: any first word of an item's sentences."""
    return F.transform(_plain(), lambda p, at: _starts(at) & (F.lit(item) | _capital(at)) & ~_number(p))


def _even(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(-2))


def codes(item: bool) -> Column:
    """An even hash of each template token, plus one if the word is doubtful."""
    slots = [_even(F.lit(x)) for x in ("<num>", "<name>", "<unit>")]

    def code(p: Column, at: Column) -> Column:
        extra = F.lit(1) if item else _capital(at).cast("int")
        return _token(p, at, *slots, _even(p), lambda rest: rest + extra)

    return F.transform(_plain(), code)


def _readings(length: int) -> list[list[int]]:
    """For each set of doubtful words among ``length`` (as bits): all its subsets, with the length above them."""
    return [[length << 8 | m for m in range(own + 1) if m & own == m] for own in range(1 << length)]


def _windows(table: DataFrame, key: str, n: int, lengths: list[int], item: bool) -> DataFrame:
    """(key, at, window, length, mask) for ``table(key, words)``: hashes of the runs of template tokens.

    The bits of ``mask`` are the doubtful words that are read as names.
    """
    short = any(length < n for length in lengths)
    arrays = {"h": codes(item)}
    if short:
        arrays["p"] = F.transform(_plain(), lambda w: F.xxhash64(w))
    rows = table.select(key, *[c.alias(a) for a, c in arrays.items()])
    # an expression and not the column: else a filter on its size is pushed below, which splits the text per word
    each = F.concat("h", F.array().cast("array<long>"))
    full = rows.select(key, *arrays, F.posexplode(each).alias("at", "first"))

    def later(array: str, i: int) -> Column:
        return F.get(F.col(array), F.col("at") + i)

    bits = F.lit(0)
    for i in range(n):
        bits = bits.bitwiseOR(F.coalesce(later("h", i).bitwiseAND(F.lit(1)), F.lit(0)).cast("int") * (1 << i))
    left = F.size("h") - F.col("at")
    every = [
        F.when(left >= x, F.get(F.lit(_readings(x)), F.col("bits").bitwiseAND((1 << x) - 1))).otherwise(F.array().cast("array<int>"))
        for x in lengths
    ]
    full = full.select(key, *arrays, "at", left.alias("left"), bits.alias("bits"))
    read = full.select(key, *arrays, "at", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("r"))
    length, mask = F.shiftright("r", 8), F.col("r").bitwiseAND(255)
    name = _even(F.lit("<name>"))
    cells = []
    for i in range(n):
        token = F.when(mask.bitwiseAND(1 << i) != 0, name).otherwise(later("h", i).bitwiseAND(F.lit(-2)))
        cells.append(F.when(length > i, token) if short else token)
    window = F.xxhash64(length, *cells)
    if short:
        slots = [_even(F.lit(x)) for x in ("<num>", "<name>", "<unit>")]
        bare = length < n
        for cell in cells:
            bare = bare & (cell.isNull() | cell.isin(*slots))
        verbatim = [F.when(length > i, later("p", i)) for i in range(n)]
        window = F.when(bare, F.xxhash64(F.lit("verbatim"), *verbatim)).otherwise(window)
    return read.select(key, "at", window.alias("window"), length.alias("length"), mask.alias("mask"))


def _slots(table: DataFrame, key: str, item: bool) -> DataFrame:
    """(key, at, value, sure) of the words that became placeholders, and of those that are doubtful (not sure)."""
    both = F.arrays_zip(_plain().alias("word"), template().alias("token"), doubts(item).alias("doubt"))
    sure = F.col("w.token").isin("<num>", "<name>", "<unit>")
    return (
        table.select(key, F.posexplode(both).alias("at", "w"))
        .where(sure | F.col("w.doubt"))
        .select(key, "at", F.col("w.word").alias("value"), sure.alias("sure"))
    )


def numbered(docs: DataFrame, scratch: Scratch, name: str = "row") -> DataFrame:
    """``docs`` with row numbers in the column ``name``, written down because row numbers must not move between two reads."""
    return scratch.save(docs.withColumn(name, F.monotonically_increasing_id()))


def leaks(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(row, item_id, found, windows) for every item of ``items(item_id, text)`` that leaks into a row of ``docs(row, text)``."""
    scratch = Scratch(docs.sparkSession, "llm-leaks")
    asked = scratch.save(tokenized(items.where("item_id IS NOT NULL"), "item_id"))
    size = asked.select("item_id", F.least(F.size("words"), F.lit(n)).alias("size")).where("size > 0")
    lengths = sorted(r.size for r in size.select("size").distinct().collect())  # at most n
    lengths = lengths or [n]
    read = _windows(asked, "item_id", n, lengths, True).join(size, "item_id").where("length = size").drop("size")
    read = scratch.save(read.withColumnsRenamed({"at": "item_at", "mask": "item_mask"}))
    # windows of an item are counted under their plain reading
    plain = read.where("item_mask = 0").select("item_id", "item_at", F.col("window").alias("plain"))
    known = scratch.save(read.join(plain, ["item_id", "item_at"]))
    total = scratch.save(known.groupBy("item_id").agg(F.countDistinct("plain").alias("windows")))
    places = known.select("item_id", "item_at", "window", "plain", "item_mask")
    few = known.count() <= BROADCAST_WINDOWS
    distinct = known.select("window").distinct()

    mine = _windows(tokenized(docs, "row"), "row", n, lengths, False).drop("length")
    # first the windows that occur at all, then their places in the items: a common window is not multiplied early
    hits = mine.join(F.broadcast(distinct) if few else distinct, "window", "left_semi")
    hits = scratch.save(hits)
    seen = hits.select("row", "window").distinct().join(places.select("item_id", "window", "plain").distinct(), "window")
    candidates = scratch.save(
        seen.groupBy("row", "item_id").agg(F.countDistinct("plain").alias("found"))
        .join(total, "item_id")
        .where(F.col("found") >= share * F.col("windows"))
        .select("row", "item_id", "windows")
    )
    alignment = ["row", "item_id", "shift"]
    aligned = scratch.save(
        hits.join(candidates, "row").join(places, ["item_id", "window"])
        .select(
            "row", "item_id", "windows", "plain", "item_at", (F.col("at") - F.col("item_at")).alias("shift"),
            (F.col("mask").bitwiseOR(F.col("item_mask")) == 0).alias("strong"),
        )
    )
    # slot values of the item against those of the document, alignment by alignment
    item_slots = _slots(asked, "item_id", True).withColumnsRenamed({"at": "slot", "value": "asked", "sure": "item_sure"})
    texts = docs.join(candidates.select("row").distinct(), "row", "left_semi")
    doc_slots = scratch.save(_slots(tokenized(texts, "row"), "row", False).withColumnRenamed("at", "place"))
    inside = F.explode(F.sequence(F.col("item_at"), F.col("item_at") + n - 1)).alias("slot")
    covered = aligned.select(*alignment, "strong", inside).groupBy(*alignment, "slot").agg(F.max("strong").alias("strong"))
    pairs = scratch.save(
        covered.join(item_slots, ["item_id", "slot"]).withColumn("place", F.col("slot") + F.col("shift"))
        .join(doc_slots, ["row", "place"])
        .select(*alignment, "slot", "asked", "value", (F.col("strong") & F.col("item_sure") & F.col("sure")).alias("sure"))
    )

    def torn(of: DataFrame) -> DataFrame:
        return of.groupBy(*alignment, "asked").agg(F.countDistinct("value").alias("values")).where("values > 1").drop("values")

    broken = scratch.save(torn(pairs.where("sure")).select(*alignment).distinct())
    # a reading that contradicts another is dropped with its windows, not the alignment
    contrary = pairs.join(torn(pairs), [*alignment, "asked"], "left_semi").select(*alignment, "slot").distinct()
    place = [*alignment, "item_at"]
    dropped = scratch.save(
        aligned.where("NOT strong").select(*place, inside).join(contrary, [*alignment, "slot"], "left_semi").select(*place).distinct()
        .withColumn("strong", F.lit(False))
    )
    whole = scratch.save(aligned.join(broken, alignment, "left_anti").join(dropped, [*place, "strong"], "left_anti"))
    # alignments count together if they agree: those with the best supported replacement of each value
    rank = whole.groupBy(*alignment, "windows").agg(F.countDistinct("plain").alias("found"))
    rank = scratch.save(rank.withColumn("rank", F.struct("found", -F.col("shift"))))
    values = scratch.save(pairs.where("sure").select(*alignment, "asked", "value").distinct())
    support = values.join(whole.select(*alignment, "plain").distinct(), alignment).join(rank, alignment)
    support = support.groupBy("row", "item_id", "asked", "value").agg(
        F.struct(F.countDistinct("plain"), F.max("rank")).alias("support")
    )
    ruling = support.groupBy("row", "item_id", "asked").agg(F.max_by("value", "support").alias("ruling"))
    other = values.join(ruling, ["row", "item_id", "asked"]).where("value <> ruling").select(*alignment).distinct()
    together = whole.join(other, alignment, "left_anti").groupBy("row", "item_id", "windows").agg(
        F.countDistinct("plain").alias("found")
    )
    return (
        together.unionByName(rank.select("row", "item_id", "windows", "found"))
        .groupBy("row", "item_id", "windows")
        .agg(F.max("found").alias("found"))
        .where(F.col("found") >= share * F.col("windows"))
        .select("row", "item_id", "found", "windows")
    )


def judge(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, contaminated, items (ids in order), coverage (best share)."""
    scratch = Scratch(docs.sparkSession, "llm-judge")
    rows = numbered(docs.select("doc_id", "text"), scratch)
    # rows that repeat an id have one verdict, rows without an id one each
    name = [F.col("doc_id").alias("_d"), F.when(F.col("doc_id").isNull(), F.col("row")).alias("_r")]
    found = scratch.save(
        leaks(rows, items, n, share).join(rows.select("row", "doc_id"), "row").groupBy(*name).agg(
            F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.col("found") / F.col("windows")).alias("coverage")
        )
    )
    own = F.when(F.col("doc_id").isNull(), F.col("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & own.eqNullSafe(F.col("_r"))
    return rows.select("doc_id", "row").join(found, same, "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``docs`` with all its columns, without the rows into which an item leaks."""
    scratch = Scratch(docs.sparkSession, "llm-clean")
    row = unused("row", docs.columns)
    rows = numbered(docs, scratch, row)
    gone = leaks(rows.select(F.col(row).alias("row"), "text"), items, n, share).select(F.col("row").alias(row))
    return rows.join(scratch.save(gone.distinct()), row, "left_anti").select(*docs.columns)
