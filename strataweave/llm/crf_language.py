"""Language of texts, and of each word of code-switched texts, by a linear-chain conditional random field.

A word is a run of letters (ASCII letters or bytes of other characters), A-Z lower-cased. Its features are
the word itself (lexicon), its first and last one to three bytes (affixes) and its byte trigrams with
word borders (n-grams), hashed into one table of weights per language. Transition weights between the
languages of neighbouring words are learned. Labels come from forward-backward over the whole text.

Training reads at most ``rows`` labelled rows of each language, whole texts of at most ``longest`` characters
(documented bounds). Stretches of rows of different languages are chained, so that switches are seen in training.
Prediction reads every whole text: forward-backward runs over chunks of words side by side; the chunks'
transfer matrices are chained first, which gives the same result as one pass over the whole text.

Nulls: null texts and texts without letters get ``und`` and score 0; rows with null language are not
trained on; without any labelled row all is ``und``. Rows are labelled on their own, so repeated ids do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.textops import Words, map_batches, mix, pieces

ROWS = 200
LONGEST = 50_000  # characters of a training text; longer ones are not learned from, all are labelled
TABLE_BITS = 18
CHUNK = 128
MOST_LANGUAGES = 1000
STRETCH = 12  # mean words of a training stretch
SEQUENCE = 64  # words of a training sequence
HOLD_WORDS = 600_000
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2 ** TABLE_BITS, labels)
    transition: np.ndarray  # (labels, labels) log weights


class WordFeatures:
    """Feature slots of the words of some texts."""

    def __init__(self, texts: list[bytes]):
        self.words = words = Words(texts, lower=True, letters=True)
        self.bounds = words.bounds
        n = len(words)
        if not n:
            return
        data = np.where(words.solid, words.data, 0).astype(np.uint32)
        padded = np.concatenate([[0, 0, 0], data, [0, 0, 0]]).astype(np.uint32)
        inside = np.flatnonzero(words.solid)
        gram = padded[inside + 2] | (padded[inside + 3] << np.uint32(8)) | (padded[inside + 4] << np.uint32(16))
        self.grams = self._slot(gram, 7)
        self.gram_starts = np.concatenate([[0], np.cumsum(words.ends - words.starts)[:-1]])
        affixes = []
        head = np.zeros(n, np.uint32)
        tail = np.zeros(n, np.uint32)
        length = words.ends - words.starts
        for k in range(3):
            live = length > k
            head = head | (np.where(live, padded[words.starts + 3 + k], 0).astype(np.uint32) << np.uint32(8 * k))
            tail = tail | (np.where(live, padded[words.ends + 2 - k], 0).astype(np.uint32) << np.uint32(8 * k))
            affixes += [self._slot(head, 1 + k), self._slot(tail, 4 + k)]
        lexicon = (words.hashes() >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.whole = np.stack([lexicon, *affixes])

    @staticmethod
    def _slot(code: np.ndarray, kind: int) -> np.ndarray:
        spread = (code.astype(np.uint64) + np.uint64(kind << 24)) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(words, labels) sums of weights."""
        out = np.add.reduceat(weights[self.grams], self.gram_starts, axis=0)
        for slots in self.whole:
            out += weights[slots]
        return out

    def scatter(self, values: np.ndarray) -> np.ndarray:
        """(slots, labels) sums of ``values`` of the words that have the feature."""
        owner = np.repeat(np.arange(len(self.words)), self.words.ends - self.words.starts)
        slots = np.concatenate([self.grams, self.whole.ravel()])
        rows = np.concatenate([owner, np.tile(np.arange(len(self.words)), len(self.whole))])
        return np.stack(
            [np.bincount(slots, weights=values[rows, j], minlength=1 << TABLE_BITS) for j in range(values.shape[1])],
            axis=1,
        )


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _weights_of(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)


def forward_backward(
    emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray, chunk: int = CHUNK
) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (words, labels) of sequences ``bounds[i]:bounds[i + 1]``, and expected label pairs.

    ``emission`` are positive word weights, ``transition`` positive pair weights. The first word follows
    an even mixture of labels. Pairs across two chunks are not counted.
    """
    words, labels = emission.shape
    lengths = np.diff(bounds)
    per_text = -(-lengths // chunk)
    n = int(per_text.sum())
    if n == 0:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    text = np.repeat(np.arange(len(lengths)), per_text)
    number = np.arange(n) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = bounds[:-1][text] + number * chunk
    size = np.minimum(chunk, bounds[1:][text] - starts)
    order = np.argsort(-size, kind="stable")  # long chunks first: the live ones are a prefix
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    starts, size = starts[order], size[order]
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]

    transfer = np.broadcast_to(np.eye(labels), (n, labels, labels)).copy()
    for t, m in enumerate(live):
        step = transfer[:m] @ transition * emission[starts[:m] + t][:, None, :]
        transfer[:m] = step / step.sum(axis=(1, 2), keepdims=True)

    before, after = np.full((n, labels), 1 / labels), np.full((n, labels), 1 / labels)
    most = int(per_text.max())
    firsts = np.cumsum(per_text) - per_text
    for k in range(1, most):  # chain the chunks of all texts side by side
        texts = np.flatnonzero(per_text > k)
        at, last = place[firsts[texts] + k], place[firsts[texts] + k - 1]
        before[at] = _unit(np.einsum("ni,nij->nj", before[last], transfer[last]))
        texts = np.flatnonzero(per_text > k)
        ends = firsts[texts] + per_text[texts] - 1
        at, following = place[ends - k], place[ends - k + 1]
        after[at] = _unit(np.einsum("nij,nj->ni", transfer[following], after[following]))

    forward = np.empty_like(emission)
    state = before
    for t, m in enumerate(live):
        state = _unit((state[:m] @ transition) * emission[starts[:m] + t])
        forward[starts[:m] + t] = state
    state, pairs = after.copy(), np.zeros((labels, labels))
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        rows = starts[:m] + t
        if t:
            joint = np.einsum("ni,nj->nij", forward[rows - 1], emission[rows] * state[:m]) * transition
            pairs += np.einsum("nij,n->ij", joint, 1 / joint.sum(axis=(1, 2)))
        posterior = _unit(forward[rows] * state[:m])
        forward[rows] = posterior
        state[:m] = _unit((state[:m] * emission[rows]) @ transition.T)
    return forward, pairs


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> DataFrame:
    """(lang, text, h) of at most ``rows`` whole texts per language, each of ``longest`` characters at most.

    Texts are those with the smallest hashes of id and text that are not held out and have a language.
    Rows that repeat id, language and text count once.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.where(F.length("text") <= longest)
    hashes = [F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")]
    counts = usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return usable.select("lang", "text", hashes[0])
    # a hash threshold leaves a few times the wanted rows of each language, so the window stays small
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, (4.0 * rows + 100) / r["count"]))])
    kept = usable.select("doc_id", "lang", "text", *hashes).where(
        F.pmod(F.xxhash64("h", "t"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    )
    first = Window.partitionBy("lang").orderBy("h", "t")
    chosen = kept.select("lang", "h", "t").distinct().withColumn("n", F.row_number().over(first))
    # at most rows texts per language, repeated rows once
    return (
        kept.join(F.broadcast(chosen.where(F.col("n") <= rows)), ["lang", "h", "t"])
        .dropDuplicates(["lang", "h", "t"])
        .select("lang", "text", "h")
    )


def fit(rows: list[tuple[str, str]], rounds: int = 25, seed: int = 7) -> Model:
    """Train on (language, text) rows by gradient steps over all sequences."""
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((0, 0)))
    random = np.random.default_rng(seed)
    of = {lang: i for i, lang in enumerate(labels)}
    stretches: list[tuple[int, list[bytes]]] = []
    for lang, text in rows:
        words = text.encode().split()
        at = 0
        while at < len(words):
            n = 1 + int(random.geometric(1 / STRETCH))
            stretches.append((of[lang], words[at : at + n]))
            at += n
    # half of the neighbours come from the same row, half from anywhere
    order = np.arange(len(stretches))
    moved = random.random(len(stretches)) < 0.5
    order[moved] = random.permutation(order[moved])
    text, truth = [], []
    for i in order:
        label, words = stretches[i]
        part = b" ".join(words)
        text.append(part)
        truth.append(label)
    features = WordFeatures(text)
    n = len(features.words)
    if not n:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((0, 0)))
    gold = np.repeat(np.array(truth), np.diff(features.bounds))
    k = len(labels)
    bounds = np.unique(np.append(np.arange(0, n, SEQUENCE), n))
    inner = np.ones(n, bool)
    inner[bounds[:-1]] = False  # words that follow another word of their sequence
    at = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    weights = np.zeros((1 << TABLE_BITS, k))
    transition = np.zeros((k, k))
    total_w, total_t = np.full_like(weights, 1e-8), np.full_like(transition, 1e-8)
    one = np.eye(k)[gold]
    weight = (n / np.maximum(np.bincount(gold, minlength=k), 1) / k)[gold][:, None]  # languages count alike
    for _ in range(rounds):
        emission = _weights_of(features.scores(weights))
        pair = np.exp(transition)
        posterior, expected = forward_backward(emission, bounds, pair)
        grad = features.scatter((posterior - one) * weight) / n + 1e-7 * weights
        step = (expected - seen) / max(len(at), 1) + 1e-4 * transition
        total_w += grad * grad
        total_t += step * step
        weights -= 0.5 * grad / np.sqrt(total_w)
        transition -= 0.2 * step / np.sqrt(total_t)
    return Model(labels, weights.astype(np.float32), transition)


def has_letter(text: bytes) -> bool:
    return text.isalpha() or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(texts: list[bytes], model: Model) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """Language, score and runs (first word, last word + 1, language) of each text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    k = len(model.labels)
    langs, scores, spans = [], [], []
    pair = np.exp(model.transition)

    def flush() -> None:
        emission = np.concatenate([e for e, _ in held])
        sizes = np.concatenate([np.diff(b) for _, b in held])
        held.clear()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        posterior, _ = forward_backward(emission, bounds, pair)
        best = posterior.argmax(axis=1) if len(posterior) else np.zeros(0, np.int64)
        sums = np.zeros((len(sizes), k))
        np.add.at(sums, np.repeat(np.arange(len(sizes)), sizes), posterior)
        change = np.flatnonzero(np.diff(best)) + 1
        for i, size in enumerate(sizes):
            if not size:
                langs.append(UNKNOWN)
                scores.append(0.0)
                spans.append([])
                continue
            top = int(sums[i].argmax())
            langs.append(model.labels[top])
            scores.append(float(min(1.0, sums[i, top] / size)))
            a, b = bounds[i], bounds[i + 1]
            cuts = [a, *change[np.searchsorted(change, a, "right") : np.searchsorted(change, b)], b]
            spans.append([(int(x - a), int(y - a), model.labels[best[x]]) for x, y in zip(cuts, cuts[1:])])

    if not k:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    waiting = 0
    column = pa.array(texts, pa.binary())
    for _, _, part in pieces(column, 1 << 20):
        features = WordFeatures(part)
        n = len(features.words)
        held.append((_weights_of(features.scores(model.weights)) if n else np.zeros((0, k)), features.bounds))
        waiting += n
        if waiting > HOLD_WORDS:
            flush()
            waiting = 0
    if held:
        flush()
    for i, text in enumerate(texts):  # bytes beyond ASCII need not be letters
        if langs[i] != UNKNOWN and not has_letter(text):
            langs[i], scores[i], spans[i] = UNKNOWN, 0.0, []
    return langs, np.array(scores), spans


def label_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every row; spans are runs of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** TABLE_BITS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for first, last, texts in pieces(batch.column(1), 8 << 20):
                langs, scores, spans = predict(texts, shared.value)
                rows = [[{"first": a, "last": b, "lang": x} for a, b, x in s] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(langs, pa.string()),
                     pa.array(scores, pa.float64()), pa.array(rows, kind)],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, 
        run, "doc_id long, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"
    )


def identify(docs: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> DataFrame:
    """Train on a sample of the rows of ``docs`` that are not held out, label all rows."""
    taken = sample(docs, rows, longest).orderBy("h", "lang", "text").collect()  # at most rows * languages
    return label_texts(docs, fit([(r.lang, r.text) for r in taken]))
