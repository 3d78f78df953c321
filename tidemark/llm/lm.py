"""Language-model scoring by a log-bilinear neural model trained with noise-contrastive estimation.

Counting. Words of all training texts are counted (summed in each task before they are shuffled). The model's
vocabulary is an end token and all words that are broadcast (KNOWN at most), so it grows with the corpus up to
that bound; each has its own context and target vector. Rarer words share one entry, in which a word has its
add-one share of the entry's tokens, and unseen words one share together with the entry's.

Training. The score of word w after words u, v is (c1 * R[u] + c2 * R[v]) . Q[w] + b[w]: a log-bilinear
model with a diagonal matrix for each position. The words are cut by frequency into classes, whose scores
(c1 * R[u] + c2 * R[v]) . K[k] + kb[k] use the same contexts. Each task reads the training texts of its partition
(of SHARD tokens at least) and learns its own copy of the model by minibatches of noise-contrastive estimation of
words and of classes (shared noise from their frequencies, AdaGrad) in numpy; triples that occur again in the HELD tokens it
takes at a time are learned as one with their count as weight. Each row of the model then moves by the tasks' average of
its change, weighted by how often the row was learned in each: a word that one task saw keeps all that was learned of it,
however many tasks there are. The sums are made in Spark by row, so the driver gets one model. The corpus is
learned in two parts (FIRST of 16 texts, then the others from the average of those), each text once.

Scoring. A word's probability is that of its class among all classes times its own among the class's words,
both normalised exactly. The words' counts are broadcast with the model; those of all other words are joined by
a 64-bit digest, so no count is cut off.

Defined cases: null and empty texts are one end token; a null id counts as the empty text for the held-out rule;
without training texts all counts are 0 and base scores 0; repeated rows are learned and scored each;
extra columns are left out; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, small_batches
from tidemark.llm.quality import bucket, bucket_low

FOLDS, HELD_OUT = 7, 2
HEAD, KNOWN, DIM, NOISE, BATCH, RATE = 1022, 200_000, 16, 64, 1024, 0.15
#: Tokens of a training task at least, tokens that it learns at a time, and sixteenths of the texts that are learned first.
SHARD, HELD, FIRST = 6_000_000, 1_000_000, 2
#: A triple that occurs more often among the tokens held is learned in several batches, each with this weight at most.
HEAVY = 8
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 300_000
TAIL, END = 0, 1
#: Numbers held at once while scoring.
CELLS = 200_000
#: Bytes of text scored or cut into words at once.
TEXT = 4 << 20
#: The end token's name among words, which are never empty.
END_WORD = ""
#: For each byte, whether it stands in words.
_INSIDE = bytes(b not in b"\t\n\v\f\r " for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def text_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of texts (a string or binary array; null: empty) in order, and their number in each text."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low = bytes(memoryview(data or b"")[offsets[0] : offsets[-1]]).lower()
    offsets = offsets - offsets[0]
    inside = np.frombuffer(low.translate(_INSIDE), bool)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(low)]
    starts[first] = inside[first]  # texts stand without a space between
    at = np.flatnonzero(starts)
    own = np.append(np.flatnonzero(starts[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(own), pa.py_buffer(np.frombuffer(low, np.uint8)[inside])])
    return words, np.diff(np.searchsorted(at, offsets))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a column text, with a row for the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
        ends = 0

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            return iter(t.set_column(0, "word", t.column("word").cast(pa.string())).to_batches())

        for b in small_batches(batches, 0):
            ends += b.num_rows
            found = text_words(b.column(0))[0].value_counts()
            more = pa.table({"word": found.field("values"), "c": found.field("counts")})
            held = pa.concat_tables([held, more]).group_by("word").aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(["word", "c"])
            if held.num_rows > HELD_WORDS:
                yield from out(held)
                held = held.slice(0, 0)
        if ends:
            yield from out(pa.concat_tables([held, pa.table({"word": pa.array([END_WORD.encode()], pa.binary()), "c": pa.array([ends], pa.int64())})]))

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequency_classes(frequency: np.ndarray) -> np.ndarray:
    """Each id's class. TAIL and END stand alone; the words, commonest first, are cut into about 0.6 times the square root of their number of classes
    (HEAD at most), of equal sums of root frequencies, which keeps the expected size of a token's class small."""
    n = len(frequency) - 2
    if n <= 0:
        return np.arange(len(frequency))
    upto = np.cumsum(np.sqrt(frequency[2:]))
    cut = np.minimum(upto / upto[-1] * min(HEAD, int(np.ceil(0.6 * np.sqrt(n)))), np.nextafter(HEAD, 0)).astype(np.int64)
    return np.concatenate([[TAIL, END], 2 + np.unique(cut, return_inverse=True)[1]])


class Model:
    """Parameters of the log-bilinear model, all rows of DIM numbers.

    r, q: every word's context and target vector; k: the classes' target vectors; c: the two positions' diagonals. The last number
    of a target vector is its bias, which meets a 1 in the context. Without classes, each word is one.
    """

    PARTS = ("r", "q", "k", "c")

    def __init__(self, frequency: np.ndarray, classes: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(frequency)
        self.p = frequency / frequency.sum()
        self.classes = np.arange(n) if classes is None else classes
        self.p_class = np.bincount(self.classes, self.p)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(self.classes))])  # a class's words stand together
        self.r, self.q, self.k = (rng.standard_normal((m, DIM), np.float32) for m in (n, n, len(self.p_class)))
        for part in (self.r, self.q, self.k):
            part *= np.float32(0.3)
        self.q[:, -1], self.k[:, -1] = np.log(self.p), np.log(self.p_class)
        self.c = np.ones((2, DIM), np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k) for k in self.PARTS])

    def set_flat(self, x: np.ndarray) -> None:
        at = 0
        for k in self.PARTS:
            rows = len(getattr(self, k))
            setattr(self, k, x[at : at + rows].astype(np.float32))
            at += rows

    def context(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts of words u, v, and the vectors of both."""
        ru, rv = self.r.take(u, axis=0), self.r.take(v, axis=0)
        h = ru * self.c[0]
        h += rv * self.c[1]
        h[:, -1] = 1
        return h, ru, rv

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Natural-log scores of a small vocabulary's words after each pair (row u * n + v), and the pairs' normalisers."""
        n = len(self.p)
        u, v = np.divmod(np.arange(n * n), n)
        s = self.context(u, v)[0] @ self.q.T
        return s, _log_sum(s)

    def log_p(self, u: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of words x after u, v: of the class among all classes, times of the word among its class's. Equal triples are worked out once."""
        n = len(self.p)
        triples, back = np.unique((u * n + v) * n + x, return_inverse=True)
        x = triples % n
        first = np.flatnonzero(np.diff(triples // n, prepend=-1))  # the pairs stand in order
        pairs, at = triples[first] // n, np.repeat(np.arange(len(first)), np.diff(first, append=len(triples)))
        h = self.context(pairs // n, pairs % n)[0]
        k = self.k if len(self.k) < n else self.q
        norm = np.empty(len(pairs), np.float32)
        step = max(1, CELLS // len(k))
        for i in range(0, len(pairs), step):
            norm[i : i + step] = _log_sum(h[i : i + step] @ k.T)
        kx = self.classes[x]
        out = np.empty(len(x))
        order = np.argsort(kx, kind="stable")
        cuts = np.flatnonzero(np.diff(kx[order])) + 1
        for part in np.split(order, cuts) if len(x) else ():
            kind = kx[part[0]]
            low, high = self.ends[kind], self.ends[kind + 1]
            step = max(1, CELLS // (high - low))
            for i in range(0, len(part), step):
                some = part[i : i + step]
                hs = h.take(at[some], axis=0)
                out[some] = hs @ k[kind] - norm[at[some]]
                if high - low > 1:
                    s = hs @ self.q[low:high].T
                    own = s[np.arange(len(some)), x[some] - low]
                    out[some] += own - _log_sum(s)
        return out[back]


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials."""
    with np.errstate(over="ignore", divide="ignore"):
        out = np.log(np.exp(s) @ np.ones(s.shape[1], s.dtype))
    odd = ~np.isfinite(out)
    if odd.any():
        top = s[odd].max(axis=1, keepdims=True)
        out[odd] = np.log(np.exp(s[odd] - top).sum(axis=1)) + top[:, 0]
    return out


class Trainer:
    """Noise-contrastive estimation over counted word triples, of the words and of their classes. seen: how often each row of the flat model was learned."""

    def __init__(self, model: Model, seed: int = 11):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.sq = {k: np.ones_like(getattr(model, k)) for k in Model.PARTS}
        self.seen = {k: np.zeros(len(getattr(model, k)), np.float32) for k in Model.PARTS}
        self.both = len(model.p_class) < len(model.p)
        self.log_kp = {"q": np.log(NOISE * model.p).astype(np.float32), "k": np.log(NOISE * model.p_class).astype(np.float32)}
        self.cdf = {"q": np.cumsum(model.p), "k": np.cumsum(model.p_class)}

    def _step(self, key: str, rows: np.ndarray, grad: np.ndarray) -> None:
        """AdaGrad on the rows named of a parameter."""
        at = np.sort(rows.astype(np.int64) * len(rows) + np.arange(len(rows)))
        some, order = np.divmod(at, len(rows))
        starts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        uniq = some[starts]
        g = np.add.reduceat(grad.view(np.complex64).take(order, axis=0), starts, axis=0).view(np.float32)  # two numbers in one sum
        sq = self.sq[key].take(uniq, axis=0)
        sq += g * g
        self.sq[key][uniq] = sq
        np.sqrt(sq, out=sq)
        g /= sq
        g *= np.float32(RATE)
        part = getattr(self.m, key)
        g += part.take(uniq, axis=0)
        part[uniq] = g

    def _contrast(self, key: str, h: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Learns targets x from shared noise; the gradient of h."""
        q, log_kp = getattr(self.m, key), self.log_kp[key]
        noise = np.minimum(np.searchsorted(self.cdf[key], self.rng.random(NOISE)), len(q) - 1)
        qx, qn = q.take(x, axis=0), q.take(noise, axis=0)
        good = np.einsum("ij,ij->i", h, qx) - log_kp[x]
        good = (w / (1 + np.exp(good)))[:, None]
        own = -qn
        own[:, -1] += log_kp[noise]  # the bias meets the 1 of the context
        bad = h @ own.T
        np.exp(bad, out=bad)
        bad += 1
        np.reciprocal(bad, out=bad)
        minus = -w[:, None]
        self._step(key, np.concatenate([x, noise]), np.concatenate([good * h, bad.T @ (h * minus)]))
        qx *= good
        back = bad @ qn
        back *= minus
        qx += back
        return qx

    @np.errstate(over="ignore")  # a chance of zero
    def learn(self, triples: np.ndarray, counts: np.ndarray) -> None:
        m, n = self.m, len(self.m.p)
        times = -(-counts // HEAVY)  # a frequent triple in many batches, not one with a great weight
        weights = np.repeat((counts / times).astype(np.float32), times)
        triples = np.repeat(triples, times)
        order = self.rng.permutation(len(triples))
        triples, weights = triples[order], weights[order]
        us, vs, xs = (t.astype(np.int32) for t in (triples // (n * n), triples // n % n, triples % n))
        kx = m.classes[xs]
        for key, rows in (("r", us), ("r", vs), ("q", xs), ("k", kx)):
            self.seen[key] += np.bincount(rows, weights, len(self.seen[key])).astype(np.float32)
        self.seen["c"] += weights.sum()
        for at in range(0, len(triples), BATCH):
            here = slice(at, at + BATCH)
            u, v, w = us[here], vs[here], weights[here]
            h, ru, rv = m.context(u, v)
            dh = self._contrast("q", h, xs[here], w)
            if self.both:
                dh += self._contrast("k", h, kx[here], w)
            dh[:, -1] = 0
            of_c = np.stack([np.einsum("ij,ij->j", dh, r) for r in (ru, rv)])
            self._step("r", np.concatenate([u, v]), (dh * m.c[:, None]).reshape(-1, DIM))
            self._step("c", np.arange(2), of_c)

    def weights(self) -> np.ndarray:
        return np.concatenate([self.seen[k] for k in Model.PARTS])


def _classes(batch: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ranks (-1: not known; -2: end) of all tokens of a batch, two leading ends a text, lengths of texts with those, and the words. known: words by rank."""
    words, n = text_words(batch)
    out = np.full(len(words) + 3 * len(n), -2, np.int64)
    out[np.arange(len(words)) + np.repeat(3 * np.arange(len(n)) + 2, n)] = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    return out, n + 3, words


def _places(lengths: np.ndarray) -> np.ndarray:
    """Where the tokens stand in what _classes gives, without the leading ends."""
    real = np.ones(int(lengths.sum()), bool)
    starts = np.cumsum(lengths) - lengths
    real[starts] = real[starts + 1] = False
    return np.flatnonzero(real)


def _ids(ranks: np.ndarray) -> np.ndarray:
    return np.where(ranks == -2, END, np.where(ranks >= 0, ranks + 2, TAIL))


def train(texts: DataFrame, common: list[bytes], frequency: np.ndarray, tokens: int) -> Model:
    """The model of the texts (a column text, of so many tokens). common: the words from id 2 on; frequency: tokens of each id."""
    context = texts.sparkSession.sparkContext
    classes = frequency_classes(frequency)
    model = Model(frequency, classes)
    n = len(frequency)
    columns = [f"v{d}" for d in range(DIM)]
    known = context.broadcast((common, frequency, classes))
    part = F.pmod(F.xxhash64("text"), F.lit(16))
    for turn, some in enumerate((texts.where(part < FIRST), texts.where(part >= FIRST))):
        start = context.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            words, freq, of = known.value
            words = pa.array(words, pa.binary())
            m = Model(freq, of)
            m.set_flat(start.value)
            trainer, held, size = Trainer(m, 11 + turn), [], 0

            def learn() -> None:
                trainer.learn(*np.unique(np.concatenate(held), return_counts=True))
                held.clear()

            for b in small_batches(batches, 0, TEXT):
                ranks, lengths, _ = _classes(b.column(0), words)
                ids, at = _ids(ranks), _places(lengths)
                held.append((ids[at - 2] * n + ids[at - 1]) * n + ids[at])
                size += len(at)
                if size >= HELD:
                    learn()
                    size = 0
            if held:
                learn()
            weight = trainer.weights()
            at = np.flatnonzero(weight)
            if len(at):
                change = (m.flat()[at] - start.value[at]) * weight[at, None]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight[at]), *(pa.array(np.ascontiguousarray(change[:, d])) for d in range(DIM))], names=["i", "w", *columns])

        few = max(1, int(tokens * (FIRST, 16 - FIRST)[turn] / 16) // SHARD)
        learned = some.coalesce(few).mapInArrow(run, "i int, w float, " + ", ".join(f"{c} float" for c in columns))
        sums = learned.groupBy("i").agg(F.sum("w").alias("w"), *(F.sum(c).alias(c) for c in columns)).select("i", *((F.col(c) / F.col("w")).cast("float").alias(c) for c in columns)).toArrow()  # as many rows at most as the model
        flat, at = model.flat(), sums.column("i").to_numpy()
        for d, c in enumerate(columns):
            flat[at, d] += sums.column(c).to_numpy()
        del sums
        model.set_flat(flat)
        del flat
        start.unpersist()
    known.unpersist()
    return model


def known_from(counts: DataFrame, most: int | None = None) -> int:
    """The count from which on words are broadcast: at most KNOWN have it. Read from a histogram of about a thousand bins at most."""
    bins = counts.groupBy(bucket(F.col("c")).alias("b")).agg(F.count("*").alias("n")).withColumn("low", bucket_low(F.col("b"))).orderBy(F.desc("low")).collect()
    total, least = 0, (bins[0]["low"] * 2 + 2 if bins else 1)
    for r in bins:
        total += r["n"]
        if total > (most or KNOWN):
            break
        least = r["low"]
    return int(least)


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, unigram_tail of every row."""
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    learned = rows.where("NOT held_out").select("text")
    counts = scratch.table(word_counts(learned), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = known_from(counts)
    top = counts.where((F.col("c") >= least) & (F.col("word") != END_WORD)).toArrow()  # at most KNOWN rows
    top = top.sort_by([("c", "descending"), ("word", "ascending")])
    words, c_known = top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_numpy().astype(np.int64)
    del top
    ends = counts.where(F.col("word") == END_WORD).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n_tail, v_tail = int(n - ends - c_known.sum()), int(v - (ends > 0) - len(words))
    # half a token for what was never seen
    frequency = np.maximum(np.concatenate([[n_tail, ends], c_known]).astype(float), 0.5)
    model = train(learned, words, frequency, int(n))
    sent = spark.sparkContext.broadcast((words, c_known, model))
    ln10 = float(np.log(10))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c, learned_model = sent.value
        known = pa.array(known, pa.binary())
        logs = np.concatenate([np.log10(c + 1.0), [np.log10(ends + 1.0), 0.0]])  # by rank; -2: end, -1: joined later
        for b in small_batches(batches, 2, TEXT):
            ranks, lengths, words = _classes(b.column(2), known)
            ids, starts, at = _ids(ranks), np.cumsum(lengths) - lengths, _places(lengths)
            doc = np.repeat(np.arange(b.num_rows), lengths - 2)
            u, w1, x, r = ids[at - 2], ids[at - 1], ids[at], ranks[at]
            lm = learned_model.log_p(u, w1, x) / ln10
            m = b.num_rows
            log_c = logs[r]
            tail = (x == TAIL).astype(float)
            flat = np.array([xxhash.xxh64_intdigest(w, 42) for w in words.filter(pa.array(r[r != -2] == -1)).to_pylist()], np.uint64).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, r == -1, m))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(lengths - 2), pa.array(np.bincount(doc, (r >= 0) | ((r == -2) & (ends > 0)), m).astype(np.int64)), pa.array(np.bincount(doc, log_c, m)), pa.array(np.bincount(doc, lm, m)), pa.array(np.bincount(doc, log_c * tail, m)), pa.array(np.bincount(doc, tail, m).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "log_c", "lm", "tail_log_c", "n_tail", "unknown"],
            )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, lm double, tail_log_c double, n_tail long, unknown array<long>"
    done = scratch.table(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out").mapInArrow(run, schema), "scored")
    # words beyond the known ones: none of them is frequent
    rare = counts.where((F.col("c") < least) & (F.col("word") != END_WORD)).select(F.xxhash64("word").alias("h"), "c")
    found = done.select("row", F.explode("unknown").alias("h")).join(rare, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_log"))
    out = done.drop("unknown").join(found, "row", "left").fillna(0, ["more", "more_log"])
    base = F.col("log_c") + F.col("more_log") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))
    whole = F.col("lm") + F.col("tail_log_c") + F.col("more_log") - F.col("n_tail") * F.lit(float(np.log10(n_tail + v_tail + 1.0)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"), "n_tail")
