"""Documents scored by the difference of cross-entropies under a target and a background n-gram model.

Both models are bigram models over one vocabulary: all words of all documents (A-Z lower-cased), and a start of
text. The target model counts the documents that are marked as target, the background model all documents; both
interpolate with their own unigrams in the same way. The score is the mean over the tokens of target loss minus
background loss, so lower means closer to the target.

Words and word pairs are counted under hashed keys, so the models grow with the input. How often a word is followed
by another is its count less its count as a last word, which goes along with the word.

1. Texts are dealt into chunks of bounded size and written as a table bucketed by chunk, which is read twice without
   another shuffle. Only (chunk, id) rows are joined with the marks.
2. A chunk counts its distinct keys in order and cuts them at the same hash bounds into parts. One row holds the keys
   of a part, as differences, and their counts; these rows are all that is shuffled by part.
3. A part adds up the counts of all its chunks and answers every chunk with the totals of its keys, in their order,
   so the keys do not travel back. It also adds up the words of the models; the driver only sees these sums.
4. Texts and answers of a chunk meet in one task, which works out the losses.

Keys are 62-bit hashes: two of a billion pairs share one with a probability of about 0.1. A part gets at most one
entry of a key from each chunk, however common the key is.

With ``size`` the vocabulary is the ``size`` - 2 most frequent words (ties by hash), and all others are one token.

Nulls: null and empty texts have 0 tokens and null losses; a null mark is no target; without targets the target
model is even over the vocabulary. Rows that repeat an id are scored on their own and all counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.textops import Words, groups, map_batches, mix, pieces, ship, signed
from strataweave.scratch import Scratch

PULL = 50.0  # weight of the unigrams in a bigram estimate, in counts
HOLD = 1_000_000
CHUNK_BYTES = 6 << 20
WORD, PAIR = 0, 1  # the two lowest bits of a key
START, OTHER = np.uint64(4), np.uint64(8)  # stand for hashes of words
NUMBERS = ["target", "target_last", "background", "background_last"]
COUNTS = pa.schema([
    ("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), *((n, pa.binary()) for n in NUMBERS),
    ("targets", pa.int64()), ("texts", pa.int64()),
])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word hash, n) over ``texts(text)`` with binary texts, summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held])
            values, at = np.unique(keys, return_inverse=True)
            return values, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def rows() -> pa.RecordBatch:
            keys, n = merge()
            return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for _, _, part in pieces(batch.column(0)):
                held.append(np.unique(Words(part, lower=True).hashes(), return_counts=True))
                if sum(len(k) for k, _ in held) > HOLD:
                    held[:] = [merge()]
                    if len(held[0][0]) > HOLD // 2:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    return map_batches(texts.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame, size: int) -> np.ndarray:
    """Hashes of the ``size`` - 2 most frequent words, in order."""
    top = word_counts(texts).orderBy(F.desc("n"), "word").limit(size - 2).collect()
    return np.sort(np.array([r.word for r in top], dtype=np.int64).view(np.uint64))


def tokens(texts: list[bytes], words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the previous token, hash of the token) of every word, and the texts' bounds."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, part in pieces(texts):  # bounds the memory that hashing takes
        found = Words(part, lower=True)
        parts.append(found.hashes())
        counts.append(np.diff(found.bounds))
    hashes, bounds = np.concatenate(parts), np.cumsum(np.concatenate(counts))
    if words is not None:
        hashes = np.where(np.isin(hashes, words), hashes, OTHER)
    before = np.full_like(hashes, START)
    before[1:] = hashes[:-1]
    before[bounds[:-1][bounds[:-1] < len(hashes)]] = START
    return before, hashes, bounds


def keys(kind: int, hashes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Keys of words, or of pairs of words."""
    if before is not None:
        hashes = mix(before + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + hashes
    return (mix(hashes) & ~np.uint64(3)) | np.uint64(kind)


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all first bytes before all second ones: small numbers then compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def chunked(texts: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``texts(doc_id, text)`` with a chunk number, a new one every ``chunk_bytes`` of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = np.zeros(batch.num_rows, np.int64)
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for i, length in enumerate(lengths):
                if size and size + length > chunk_bytes:
                    chunk, size = chunk + 1, 0
                numbers[i] = chunk
                size += length
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *batch.columns], ["chunk", "doc_id", "text"])

    return map_batches(texts, run, "chunk long, doc_id long, text binary")


class Counted:
    """The distinct keys of some texts in order, and where every token's keys are among them."""

    def __init__(self, texts: list[bytes], words: np.ndarray | None):
        before, now, self.bounds = tokens(texts, words)
        self.first = before == START
        self.last = np.append(self.first[1:], True)[: len(now)]
        word, word_at = np.unique(keys(WORD, now), return_inverse=True)
        pair, pair_at = np.unique(keys(PAIR, now, before), return_inverse=True)
        both = np.concatenate([word, pair])
        order = np.argsort(both)
        place = np.empty(len(both), np.int64)
        place[order] = np.arange(len(both))
        self.values, self.is_word = both[order], (order < len(word))
        self.word, self.pair = place[word_at], place[len(word) + pair_at]

    def counts(self, marks: np.ndarray) -> list[np.ndarray]:
        """For the marked texts and for all: how often each key occurs, and how often it is a last word."""
        mine = np.repeat(marks, np.diff(self.bounds))
        out = []
        for some in (mine, np.ones_like(mine)):
            out.append(np.bincount(np.concatenate([self.word[some], self.pair[some]]), minlength=len(self.values)))
            out.append(np.bincount(self.word[some & self.last], minlength=len(self.values)))
        return out

    def losses(self, total: np.ndarray, ends: np.ndarray, tokens: int, texts: int, distinct: int) -> np.ndarray:
        """The loss of every token in nats, under a model with these counts of the keys and of last words."""
        word, pair = (total[x].astype(np.float64) for x in (self.word, self.pair))
        given = np.empty(len(word))
        given[1:] = (word - ends[self.word])[:-1]
        given[self.first] = texts
        unigram = (word + 1) / max(tokens + distinct, 1)
        return np.log(given + PULL) - np.log(pair + PULL * unigram)


def score(docs: DataFrame, targets: DataFrame, size: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) per row of ``docs(doc_id, text)``.

    ``targets(doc_id)`` lists the documents of the target model; losses are means over tokens in nats.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "llm-cross-entropy")
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    words = None if size is None else vocabulary(table, size)
    shared = None if words is None else spark.sparkContext.broadcast(words)
    volume = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as many buckets as other shuffles have partitions at least, so that the table is not shuffled again
    parts = max(1, -(-volume // chunk_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # written down because chunk numbers must not move between two reads
    table = scratch.save_bucketed(chunked(table, chunk_bytes), "chunk", parts)
    marks = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    # the marks grow with the labels, so they are joined by a shuffle at every size
    ids = table.select(F.col("chunk").alias("of"), F.col("doc_id").alias("id"))
    marked = ids.join(marks.toDF("id").hint("merge"), "id").select(F.col("of").alias("chunk"), "id").distinct()

    def count(texts: pa.Table, marked: pa.Table) -> pa.Table:
        mine = Counted([t or b"" for t in texts.column("text").to_pylist()], shared and shared.value)
        is_mark = pa.compute.is_in(texts.column("doc_id"), marked.column("id")).to_numpy()
        counts = mine.counts(is_mark)
        filled = np.diff(mine.bounds) > 0
        # keys use the 62 bits above the kind, so these bounds are even
        cuts = np.searchsorted(mine.values, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64))
        rows = []
        for i, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(mine.values)])):
            if a < b or not i:
                word = mine.is_word[a:b]
                sent = [c[a:b] if n % 2 == 0 else c[a:b][word] for n, c in enumerate(counts)]
                steps = np.diff(mine.values[a:b], prepend=np.uint64(0))
                own = [0, 0] if i else [int((filled & is_mark).sum()), int(filled.sum())]
                rows.append([texts.column("chunk")[0].as_py(), i, planes(steps), *map(planes, sent), *own])
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), COUNTS)], schema=COUNTS)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["part"]):
            own = [np.cumsum(unplanes(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
            values, at = np.unique(np.concatenate(own), return_inverse=True)
            cuts = np.cumsum([len(k) for k in own])[:-1]
            word = (values & np.uint64(3)) == WORD
            sums, back = [], []
            for name in NUMBERS:
                of = at if name in ("target", "background") else at[word[at]]
                each = np.concatenate([unplanes(c) for c in group.column(name).to_pylist()])
                # sums of doubles are exact up to 2 ** 53
                whole = np.bincount(of, weights=each, minlength=len(values)).astype(np.int64)
                sums.append(int(whole[word].sum()))
                back.append([planes(c if of is at else c[word[i]]) for c, i in zip(np.split(whole[at], cuts), np.split(at, cuts))])
            sums = [sums[0], sums[2], int(word.sum())]
            sums += [int(pa.compute.sum(group.column(n)).as_py()) for n in ("targets", "texts")]
            yield pa.RecordBatch.from_arrays(
                [group.column("chunk").combine_chunks(), group.column("part").combine_chunks(),
                 *(pa.array(b, pa.binary()) for b in back),
                 pa.array([sums] + [None] * (group.num_rows - 1), pa.list_(pa.int64()))],
                ["chunk", "part", *NUMBERS, "sums"])

    ship(spark)
    numbers = ", ".join(f"{n} binary" for n in NUMBERS)
    counts = table.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(
        count, f"chunk long, part int, keys binary, {numbers}, targets long, texts long"
    )
    dealt = counts.repartition(parts, "part").sortWithinPartitions("part")
    answers = scratch.save(map_batches(dealt, total, f"chunk long, part int, {numbers}, sums array<long>"))
    sums = answers.where("sums IS NOT NULL").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(5)]).first()
    in_target, in_all, distinct, targets_, texts_ = (x or 0 for x in sums)
    if size is not None:
        distinct = size - 1

    def losses(texts: pa.Table, known: pa.Table) -> pa.Table:
        mine = Counted([t or b"" for t in texts.column("text").to_pylist()], shared and shared.value)
        n = np.diff(mine.bounds)
        owner = np.repeat(np.arange(texts.num_rows), n)
        known = known.sort_by("part")
        sums = []
        for name, tokens_, filled in (("target", in_target, targets_), ("background", in_all, texts_)):
            whole = np.concatenate([unplanes(x) for x in known.column(name).to_pylist()])
            ends = np.zeros(len(whole))
            ends[mine.is_word] = np.concatenate([unplanes(x) for x in known.column(f"{name}_last").to_pylist()])
            loss = mine.losses(whole, ends, tokens_, filled, distinct) if len(owner) else np.zeros(0)
            sums.append(np.bincount(owner, weights=loss, minlength=texts.num_rows))
        none = n == 0
        target, background, both = (pa.array(s / np.maximum(n, 1), mask=none) for s in (*sums, sums[0] - sums[1]))
        return pa.table({
            "doc_id": texts.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "target_loss": target,
            "background_loss": background, "score": both,
        })

    return table.groupBy("chunk").cogroup(answers.drop("sums").groupBy("chunk")).applyInArrow(
        losses, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    )
