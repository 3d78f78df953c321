"""MinHash near duplicates by a multi-index Hamming join, confirmed on full shingle sets.

1. Each text's set of word shingles gives a set id (equal sets are one class, represented by its smallest
   document id) and a signature of POSITIONS 16-bit min-hashes.
2. Signatures are split into CHUNKS chunks. By the pigeonhole principle two signatures that differ in at most
   RADIUS = 2 * CHUNKS - 1 positions have a chunk with at most one error, so every chunk is indexed once for
   each position left out: all pairs within RADIUS share a key. At a similarity of 0.8 a pair differs in 12 of
   60 positions on average; the chance that it shares no key is (P[2 or more of 5 differ]) ** 12, about 1e-7.
3. Rows of a key meet sorted, in a stream. Pairs whose set sizes rule the similarity out, or whose 2-bit
   signatures differ in more than SKETCH_MOST of 60 positions (expected 9, 24 is over five deviations away),
   are left out. Keys of up to SMALL classes give their pairs; larger ones give each member's pair with one
   centre, then that of each member not yet in the commonest component with a centre of that. Keys of more than HOT classes never meet in one
   task: they are counted first, and their rows are joined with their centres where they are. What is still
   apart is held against all of its keys' classes in blocks, with an index of shingles (``across``). So a group
   of n near copies costs about n pairs, no pairs of a group are ever rows, and no link between components
   is missed.
4. Pairs are confirmed by comparing their full sets; links give connected components.

Texts lower-case A-Z only; words are runs of bytes other than space, \\t, \\n, \\v, \\f, \\r. Texts with fewer words
than a shingle are one shingle; texts without words have no set, no links and are their own component.
Set ids are 64-bit digests of the whole sorted set (two different sets of n are taken for equal with a chance of
n * n / 2 ** 65).

Defined cases: null text is empty; null ids belong to their class but never name it, unless all are null;
repeated rows get equal results; texts are whole, however long; ties fall to the smallest id; extra columns
are left out by ``near_duplicates`` and stay in ``drop_near_duplicates``; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hint_if_small, packed, small_batches
from tidemark.llm.graph import components

SHINGLE, PERCENT = 5, 80
POSITIONS, CHUNKS = 60, 12
PER = POSITIONS // CHUNKS
RADIUS = 2 * CHUNKS - 1
SMALL, SKETCH_MOST, HOT, BLOCK, BLOCK_BYTES = 24, 24, 1000, 500, 16 << 20
#: Ids of a join's smaller side that are broadcast at most (16 bytes each).
IDS = 400_000

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, POSITIONS, np.uint32)[:, None]
_ODD = (_rng.integers(0, 1 << 32, POSITIONS, np.uint32) | np.uint32(1))[:, None]
_MIX = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit shingle digests of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    last = len(words) - n + 1
    s = h[:last] * _MIX[0]
    for k in range(1, n):
        s = s * _MIX[1] + h[k : k + last]
    return np.unique(_scramble(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS 16-bit min-hashes of a set that is not empty."""
    low = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1 << 15):
        low = np.minimum(low, ((x[i : i + (1 << 15)] ^ _XOR) * _ODD).min(axis=1))
    return (low * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null without a set), sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            sizes, ids, sigs = [], [], []
            for text in b.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py() or b"", n)
                sizes.append(len(s))
                ids.append(_signed(xxhash.xxh64_intdigest(s.tobytes())) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id long, sig binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """POSITIONS keys for each class (set_id, n_shingles, sig): key, id, n, the position left out with its value, and the 2-bit signature in two longs."""
    kinds = [("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("out", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                m = b.num_rows
                sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(m, POSITIONS).astype(np.uint64)
                ids, ns = (np.asarray(b.column(i)) for i in (0, 1))
                two = sig & np.uint64(3)
                half = POSITIONS // 2
                s1, s2 = ((two[:, p : p + half] << (np.arange(half, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64) for p in (0, half))
                keys, outs = np.empty((m, POSITIONS), np.uint64), np.empty((m, POSITIONS), np.int32)
                for c in range(CHUNKS):
                    for o in range(PER):
                        rest = [c * PER + p for p in range(PER) if p != o]
                        k = np.zeros(m, np.uint64)
                        for p in rest:
                            k = (k + sig[:, p] + np.uint64(1)) * _MIX[2]
                        keys[:, c * PER + o] = _scramble(k ^ _MIX[3 + c] + np.uint64(o))
                        outs[:, c * PER + o] = o << 16 | sig[:, c * PER + o].astype(np.int32)
                rep = lambda x: np.repeat(x, POSITIONS)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip((keys.ravel().view(np.int64), rep(ids), rep(ns), outs.ravel(), rep(s1), rep(s2)), kinds, strict=True)], names=[k for k, _ in kinds])

    return classes.select("set_id", "n_shingles", "sig").mapInArrow(run, "key long, id long, n long, out int, s1 long, s2 long")


MEMBER = ("key", "id", "n", "out", "s1", "s2")
_EVEN_BITS = 0x5555555555555555


def _plausible(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which row pairs can be similar: by sizes, 2-bit signatures, and met only at the first key of a chunk they agree on."""
    n, m = c["n"][i], c["n"][j]
    ok = (c["id"][i] != c["id"][j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    ok &= (c["out"][i] != c["out"][j]) | (c["out"][i] >> 16 == 0)
    i, j = i[ok], j[ok]
    off = np.zeros(len(i), np.uint8)
    for s in ("s1", "s2"):
        x = c[s][i] ^ c[s][j]
        off += np.bitwise_count((x | x >> 1) & np.int64(_EVEN_BITS))
    ok[ok] = off <= SKETCH_MOST
    return ok


def plausible(percent: int) -> Column:
    """The same of a row and its key's centre (c_id, c_n, ...), as a column."""
    off = lambda k: F.bit_count((x := F.col(k).bitwiseXOR(F.col(f"c_{k}"))).bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(_EVEN_BITS)))
    first = (F.col("out") != F.col("c_out")) | (F.shiftright("out", 16) == 0)
    return (F.col("id") != F.col("c_id")) & (100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")) & first & (off("s1") + off("s2") <= SKETCH_MOST)


def _centre() -> Column:
    """The row with the least digest of its id, as a struct."""
    return F.min(F.struct(F.xxhash64("id").alias("c_h"), *(F.col(k).alias(f"c_{k}") for k in MEMBER[1:])))


def _pair_columns() -> list[Column]:
    return [F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b")]


def meet(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (member false: a, b) of the rows of each key, and (member true) the rows of keys with more than SMALL: all pairs of small keys, one centre for larger ones. rows: MEMBER columns, no key of more than some thousand."""
    kinds = [("member", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("out", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())]

    def pairs(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = _plausible(c, i, j, percent)
        ab = np.stack([c["id"][i[ok]], c["id"][j[ok]]], axis=1)
        ab.sort(axis=1)
        return ab

    def pair_batch(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found and sum(map(len, found)):
            ab = np.unique(np.concatenate(found), axis=0)
            m = len(ab)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, bool)), pa.array(np.ascontiguousarray(ab[:, 0])), pa.array(np.ascontiguousarray(ab[:, 1])), *(pa.nulls(m, t) for _, t in kinds[3:])], names=[k for k, _ in kinds])
        found.clear()

    def member_batch(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        m = len(c["id"])
        return pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.array(c["id"]), pa.nulls(m, pa.int64()), *(pa.array(c[k], t) for k, t in kinds[3:])], names=[k for k, _ in kinds])

    def done(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole groups."""
        starts = np.flatnonzero(np.concatenate([[True], c["key"][1:] != c["key"][:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(c["key"])]]))
        found: list[np.ndarray] = []
        for g in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
            first = starts[sizes == g]
            step = max(1, 500_000 // int(g * g))
            x, y = np.triu_indices(g, 1)
            for at in range(0, len(first), step):
                f = first[at : at + step, None]
                found.append(pairs(c, (f + x).ravel(), (f + y).ravel()))
        for s, g in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            own = {k: v[s : s + g] for k, v in c.items()}
            k = int(np.argmin(_scramble(own["id"].view(np.uint64))))
            found.append(pairs(own, np.full(g, k), np.arange(g)))
            if sum(map(len, found)) > 200_000:
                yield from pair_batch(found)
            # rows equal to the centre in the whole chunk meet again at the chunk's first key; more than SMALL of them, and that key is large
            same = own["out"] == own["out"][k]
            if own["out"][k] >> 16 and same.sum() > SMALL:
                same[k] = False
                own = {x: v[~same] for x, v in own.items()}
            yield member_batch(own)
        yield from pair_batch(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            new = {k: np.asarray(b.column(i)) for i, k in enumerate(MEMBER)}
            c = {k: np.concatenate([held[k], v]) for k, v in new.items()} if held else new
            held = {}
            if len(c["key"]):
                cut = int(np.searchsorted(c["key"], c["key"][-1], "left"))
                if cut:
                    yield from done({k: v[:cut] for k, v in c.items()})
                held = {k: v[cut:] for k, v in c.items()}
        if held:
            yield from done(held)

    near = rows.select(*MEMBER).repartition("key").sortWithinPartitions("key")
    return near.mapInArrow(run, "member boolean, a long, b long, key long, n long, out int, s1 long, s2 long")


def met_pairs(classes: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), and the members (MEMBER) of keys with more than SMALL classes. Keys of more than HOT are found by counting (summed before the shuffle) and joined with their centres in place."""
    keyed = index_keys(classes)
    hot = scratch.table(keyed.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot")
    n_hot = hot.count()
    cold = keyed if not n_hot else keyed.join(hint_if_small(hot, n_hot), "key", "left_anti")
    met = scratch.table(meet(cold, percent), "met")
    pairs, members = met.where("NOT member").select("a", "b"), met.where("member").select("key", F.col("a").alias("id"), "n", "out", "s1", "s2")
    if n_hot:
        hot_rows = scratch.table(keyed.join(hint_if_small(hot, n_hot), "key"), "hot-rows")
        centres = scratch.table(hot_rows.groupBy("key").agg(_centre().alias("c")).select("key", "c.*").drop("c_h"), "centres")
        rows = hot_rows.join(hint_if_small(centres, n_hot), "key")
        pairs = pairs.union(rows.where(plausible(percent)).select(*_pair_columns()))
        # as in meet: what equals the centre in the whole chunk stands in the chunk's first key too
        again = (F.shiftright("c_out", 16) != 0) & (F.col("out") == F.col("c_out"))
        many = rows.where(again).groupBy("key").count().where(F.col("count") > SMALL).select("key", F.lit(True).alias("many"))
        kept = rows.join(hint_if_small(many, bound=IDS), "key", "left").where(~(again & (F.col("id") != F.col("c_id")) & F.coalesce("many", F.lit(False))))
        members = members.union(kept.select(*MEMBER))
    return scratch.table(pairs.distinct(), "pairs"), scratch.table(members, "members")


def star(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of each key's rows (MEMBER and label) with a centre of the key's commonest label, where theirs is another."""
    per = members.groupBy("key", "label").agg(F.count("*").alias("size"), _centre().alias("c"))
    best = per.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("size", "label", "c")).alias("m")).where("labels > 1")
    best = best.select("key", F.col("m.label").alias("c_label"), "m.c.*").drop("c_h")
    best = hint_if_small(scratch.table(best, "centres"), bound=IDS)
    return members.join(best, "key").where(F.col("label") != F.col("c_label")).where(plausible(percent)).select(*_pair_columns()).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: id, text."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[int, np.ndarray]] = {}

        def full(side: int, key: int, text: pa.Scalar) -> np.ndarray:
            if side not in last or last[side][0] != key:
                last[side] = key, shingle_set((text.as_py() or "").encode(), n)
            return last[side][1]

        for b in batches:
            ids = [b.column(i).to_pylist() for i in (0, 1)]
            good = [similar(full(0, i, x), full(1, j, y), percent) for i, j, x, y in zip(*ids, b.column(2), b.column(3), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def across(members: DataFrame, labels: DataFrame, texts: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join components among the classes of large keys, by comparing full sets.

    Keys that share a class form a field. In each field the classes outside its commonest component are held against all of
    its classes, in blocks of about BLOCK classes or BLOCK_BYTES of text of each, whichever is more blocks, each block with an index from
    shingles to classes: a similar class holds one of any (1 - percent) of a class's shingles, so only the block's rarest ones are looked up.
    """
    least = members.groupBy("key").agg(F.min("id").alias("b"))
    fields = components(members.join(least, "key").select(F.col("id").alias("a"), "b"), scratch).withColumnRenamed("label", "field")
    at = scratch.table(fields.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "fields")
    sizes = at.groupBy("field", "label").count().groupBy("field").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.sum("count").alias("all"), F.max("count").alias("top"))
    open_rows = at.join(sizes.where("all > top").select("field", "most"), "field").join(texts, "id").withColumn("bytes", F.octet_length("text"))
    rows = scratch.table(open_rows, "open")
    asking = F.col("label") != F.col("most")
    parts = lambda n, b: F.greatest(F.ceil(n / BLOCK), F.ceil(b / BLOCK_BYTES), F.lit(1)).cast("long")
    totals = rows.groupBy("field").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.count_if(asking).alias("an"), F.coalesce(F.sum(F.when(asking, F.col("bytes"))), F.lit(0)).alias("ab"))
    rows = rows.join(scratch.table(totals.select("field", parts(F.col("n"), F.col("b")).alias("blocks"), parts(F.col("an"), F.col("ab")).alias("chunks")), "blocks"), "field")
    deal = lambda seed, m: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(m))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    keep = ("id", "label", "text", "field")
    held = rows.select(*keep, deal(1, "blocks").alias("block"), each("chunks").alias("chunk"), F.lit(False).alias("asks"))
    asks = rows.where("label <> most").select(*keep, each("blocks").alias("block"), deal(2, "chunks").alias("chunk"), F.lit(True).alias("asks"))

    def compare(table: pa.Table) -> pa.Table:
        ids, labels, ask = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "asks"))
        sets = [shingle_set((t.as_py() or "").encode(), n) for t in table.column("text")]
        mine = np.flatnonzero(~ask)
        owner = np.repeat(mine, [len(sets[i]) for i in mine])
        tokens = np.concatenate([sets[i] for i in mine]) if len(mine) else np.empty(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        sizes = np.array([len(x) for x in sets])
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.setdefault(x, x) != x:
                joined[x] = x = joined[joined[x]]
            return x

        links: list[tuple[int, int]] = []
        for q in np.flatnonzero(ask):
            s = sets[q]
            lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
            rare = np.argsort(hi - lo)[: len(s) - -(-percent * len(s) // 100) + 1]
            near = np.unique(np.concatenate([owner[lo[k] : hi[k]] for k in rare]))
            for i in near[(labels[near] != labels[q]) & (100 * np.minimum(sizes[near], sizes[q]) >= percent * np.maximum(sizes[near], sizes[q]))]:
                x, y = root(int(labels[q])), root(int(labels[i]))
                if x != y and similar(s, sets[i], percent):
                    joined[x] = y
                    links.append((min(ids[q], ids[i]), max(ids[q], ids[i])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return held.unionByName(asks).groupBy("field", "block", "chunk").applyInArrow(compare, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    scratch = scratch or Scratch(spark, "neardup")
    rows = scratch.table(signatures(docs, id_col, text_col, n), "signatures")
    classes = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
    classes = scratch.table(classes, "classes")
    pairs, members = met_pairs(classes, percent, scratch)
    # whole texts of the classes that have a pair or stand in a large key
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(members.select("id")).distinct()
    wanted = scratch.table(wanted.join(classes.select("set_id", "first"), "set_id").where("first IS NOT NULL"), "wanted")
    own = F.col(id_col).cast("long")
    texts = docs.select(own.alias("first"), F.col(text_col).cast("string").alias("text")).join(hint_if_small(wanted, bound=IDS), "first")
    # an id may stand for several texts: only the one with the class's set counts
    texts = scratch.table(_checked(texts, n), "texts")
    links = scratch.table(confirm(pairs, texts, n, percent), "links")
    labels = components(links, scratch)
    if not members.isEmpty():
        labels = scratch.table(labels, "labels")
        more = star(members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), percent, scratch)
        more = scratch.table(more.join(pairs, ["a", "b"], "left_anti"), "more")
        new = scratch.table(confirm(more, texts, n, percent), "links")
        every = links.union(new)
        if not new.isEmpty():
            labels = scratch.table(components(every, scratch), "labels")
        new = scratch.table(across(members, labels, texts, n, percent, scratch), "links")
        if not new.isEmpty():
            labels = components(every.union(new), scratch)
    ids = labels.join(classes.select(F.col("set_id").alias("id"), "first"), "id")
    names = ids.groupBy("label").agg(F.min("first").alias("component"))
    named = ids.join(names, "label").select(F.col("id").alias("set_id"), "component")
    final = scratch.table(classes.join(named, "set_id", "left").select("set_id", F.coalesce("component", "first").alias("component")), "components")
    out = rows.drop("sig").join(final, "set_id", "left").withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _checked(texts: DataFrame, n: int) -> DataFrame:
    """(id, text), once per set_id, of the rows (first, text, set_id) whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [_signed(xxhash.xxh64_intdigest(shingle_set((t.as_py() or "").encode(), n).tobytes())) == k for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["id", "text"])

    return texts.select("set_id", "text").mapInArrow(run, "id long, text string")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows of every component but those of its smallest id; rows that share that id are one row. Rows without an id stay."""
    scratch = Scratch(spark, "neardup")
    found = scratch.table(near_duplicates(spark, docs, id_col, text_col, n, percent, scratch), "found")
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone")).distinct()
    gone = scratch.table(gone, "gone")
    rows = docs.select(packed(docs), F.col(id_col).cast("long").alias("id"))
    out = rows.join(hint_if_small(gone, bound=IDS), F.col("id") == F.col("gone"), "left_anti")
    repeated = found.where("kept").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        out = out.where("id IS NOT NULL").dropDuplicates(["id"]).unionByName(out.where("id IS NULL"))
    return out.select("row.*")
