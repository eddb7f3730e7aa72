"""Toxicity by class-conditional Kneser-Ney models of words after words, of words alone, and of the beginnings that rare words share."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.filters import bit_filter, passes
from textloom.llm.scratch import Scratch, as_row, lean, small_batches

#: Labelled rows that the four weights of the calibration are fitted on at most, chosen by a hash of doc_id; the counts are of all labelled rows.
CALIBRATION_ROWS = 40_000
#: Pairs of words in fewer labelled texts back off to the second word, words to a shorter beginning; absolute discount; log-likelihood ratio up to which a word says nothing.
SEEN, DISCOUNT, MARGIN = 3, 0.75, 2.0
CUT = 0.3
#: Beginnings of so many bytes or more share one backoff weight; parts of a unit that ratios are summed in; words that a task counts at once.
DEPTHS, UNIT, WORDS = 12, 1 << 16, 1_000_000
#: Labelled texts for each bucket of pairs; up to so many buckets, all pairs that end in a word are in one.
BUCKET_TEXTS, BUCKETS = 1024, 64
_WORDS = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else i if i > 127 else 32 for i in range(256))
_FNV, _BASIS, _END = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325), b"$"
#: Folds that are learnt from; each also has a model of the others, which judges it for the calibration. Model 0 is that of all.
FOLDS = 3
_MODELS = range(FOLDS + 1)
_COUNTS = tuple(f"n{k}" for k in range(2 * FOLDS))  # labelled texts by fold and class: n0 and n1 of the first fold, ordinary and toxic
_FOLLOW = tuple(f"f{k}" for k in range(2 * FOLDS))  # what follows a word, by fold and class: the distinct pairs that it begins, summed over texts
_SPREAD = tuple(f"c{m}{y}" for m in _MODELS for y in (0, 1))  # distinct preceding words by model and class
_TYPES = tuple(f"t{m}" for m in _MODELS)  # distinct preceding words by model, of both classes
_VALUES = tuple(f"v{m}" for m in _MODELS)


def words_of(raw: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of other characters beyond ASCII, A-Z in lower case."""
    return raw.translate(_WORDS).split() if raw else []


class Spelt:
    """Words laid out for a walk over their beginnings of 1, 2, ... bytes up to their ends, an end mark last."""

    def __init__(self, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(w + _END for w in words), np.uint8)
        self.state = np.full(len(words), _BASIS)

    def step(self, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``alive`` that have k + 1 bytes, and the 64-bit hash of these; their first k must have been walked."""
        alive = alive[self.size[alive] > k]
        h = (self.state[alive] ^ (self.letters[self.start[alive] + k].astype(np.uint64) + np.uint64(1))) * _FNV
        self.state[alive] = h
        return alive, h ^ (h >> np.uint64(29))


def beginnings(words: list[bytes], rows: int = 200_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of about ``rows`` (word, hash of a beginning, hash of the one a byte shorter, bytes); all of one length are in one block."""
    spelt, alive, last = Spelt(words), np.arange(len(words)), np.full(len(words), _BASIS)
    held, n, k = [], 0, 0
    while len(alive):
        alive, h = spelt.step(alive, k)
        held.append((alive, h, last[alive], np.full(len(h), k + 1, np.int32)))
        last[alive] = h
        n, k = n + len(alive), k + 1
        if n >= rows or not len(alive):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0


def whole_words(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word with its end mark, as ``beginnings`` has it last."""
    spelt, alive, out, k = Spelt(words), np.arange(len(words)), np.zeros(len(words), np.uint64), 0
    while len(alive):
        alive, h = spelt.step(alive, k)
        out[alive] = h
        k += 1
    return out


def fold(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def _of(model: int, y: int) -> list[int]:
    """Which counts are a model's of a class: those of all folds but its own."""
    return [2 * k + y for k in range(FOLDS) if k != model - 1]


def _labelled_words(docs: DataFrame, labels: DataFrame, scratch: Scratch, held_out: int, order: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, toxic, fold) of the labels that may be learnt from, folds from 0, as written; and counts of their texts' words and pairs of words, in parts, as ``_tally`` packs them."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % (FOLDS + 1)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.where(crc != held_out).withColumn("fold", (crc - (crc > held_out).cast("int")).cast("int"))
    chosen = scratch.write(chosen, "labels")
    buckets = max(BUCKETS, chosen.count() // BUCKET_TEXTS)
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(chosen, "doc_id"))

    def some(batches):
        for b in batches:
            ids = b.column(0)
            at = np.flatnonzero(passes(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & ids.is_valid().to_numpy(zero_copy_only=False))
            texts = [zlib.compress(b" ".join(words_of(x) if order > 1 else dict.fromkeys(words_of(x))), 1) for x in b.column(1).take(pa.array(at)).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(texts, pa.binary())], ["doc_id", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(some), "doc_id long, words binary")
    return chosen, texts.join(chosen, "doc_id").select("words", "toxic", "fold").mapInArrow(lean(_tally(order, WORDS, buckets)), _PACKED)


#: A block's pairs that end in words of a bucket: the hashes of preceding words; and, compressed, the words, joined by blanks; the pairs of each;
#: which hash each pair has; and in a byte its fold and class, and texts: up to _MANY, else the pair stands there several times.
_PACKED, _MANY = "bucket int, contexts binary, words binary, pairs binary, context binary, seen binary", 256 // (2 * FOLDS)
#: In place of a preceding word's hash: the texts that hold the word, and what follows it.
_OWN, _NEXT = 0, 1


def _bucket(word: np.ndarray, ctx: np.ndarray, buckets: int) -> np.ndarray:
    """A pair's bucket. With many buckets, the pairs that end in a word are dealt over several."""
    part = (ctx >> np.uint64(7)) % np.uint64(max(1, buckets // BUCKETS)) * np.uint64(0x9E3779B1)
    return (((word >> np.uint64(5)) + part) % np.uint64(buckets)).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted in place, without copies of equal values."""
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _tally(order: int, block: int, buckets: int):
    """Counts of labelled texts by word and preceding word, packed by bucket; the start of texts is an empty word."""

    def keys(index, size, classes, start):
        """(word, preceding word or mark, class) in one number, once for each text that holds it, sorted."""
        wide, doc = start + 3, np.repeat(np.arange(len(size)), size)
        held = _distinct(np.concatenate([doc * wide + index, np.flatnonzero(size) * wide + start]))
        out = [(held % wide * wide + start + 1) * len(_COUNTS) + classes[held // wide]]
        if order > 1:
            before = np.empty(len(index), np.int64)
            before[1:] = index[:-1]
            before[(np.cumsum(size) - size)[size > 0]] = start
            before += (doc * wide + index) * wide
            held = _distinct(before)
            of = classes[held // wide**2]
            out += [held % wide**2 * len(_COUNTS) + of, (held % wide * wide + start + 2) * len(_COUNTS) + of]
        out = np.concatenate(out)
        out.sort()
        return out

    def flush(words, index, size, classes):
        start, wide = len(words), len(words) + 3  # the numbers of the start and, as preceding words, of the two marks
        h = np.append(whole_words(words), [_BASIS, np.uint64(_OWN), np.uint64(_NEXT)])
        words.append(b"")
        key = keys(index, size, classes, start)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n, key = np.diff(np.append(first, len(key))), key[first]
        again = -(-n // _MANY)
        key, many = np.repeat(key, again), np.full(again.sum(), _MANY, np.int16)
        many[np.cumsum(again) - 1] = n - _MANY * (again - 1)
        seen = (key % len(_COUNTS) + len(_COUNTS) * (many - 1)).astype(np.uint8)
        key //= len(_COUNTS)
        word, ctx = (key // wide).astype(np.int32), (key % wide).astype(np.int32)
        del key, first, n, again, many
        bucket = _bucket(h[word], h[ctx], buckets).astype(np.int32)
        at = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[at], np.arange(buckets + 1))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            z = at[cuts[k] : cuts[k + 1]]
            ends, pairs = np.unique(word[z], return_counts=True)
            contexts, context = np.unique(ctx[z], return_inverse=True)
            small = (zlib.compress(x, 1) for x in (b" ".join([words[w] for w in ends]), pairs.astype("<i4").tobytes(), context.astype("<i4").tobytes(), seen[z].tobytes()))
            yield int(k), h[contexts].tobytes(), *small

    def run(batches):
        number, texts, classes, held = defaultdict(), [], [], 0  # texts as numbers of words
        number.default_factory = number.__len__

        def rows():
            size, words, index = np.fromiter(map(len, texts), np.int64, len(texts)), list(number), np.concatenate(texts)
            texts.clear()
            number.clear()
            for row in flush(words, index, size, np.array(classes, np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 5), strict=True)], [x.split()[0] for x in _PACKED.split(", ")])
            classes.clear()

        for b in batches:
            for words, toxic, fold in zip(*b.columns, strict=True):
                words = zlib.decompress(words.as_py()).split()
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                classes.append(2 * fold.as_py() + toxic.as_py())
                held += len(words)
                if held > block:
                    yield from rows()
                    held = 0
        if held:
            yield from rows()

    return run


_COUNTED = ["word", "ctx", "h", *_COUNTS, *_FOLLOW, *_SPREAD, *_TYPES]


def _merged(batches):
    """From packed rows sorted by bucket: the pairs that SEEN or more texts hold, and for each word, without ctx, its counts and the distinct words that precede it, also in rarer pairs."""

    def flush(rows):
        spelt = pa.array([w for r in rows for w in r[0].split(b" ")], pa.binary()).dictionary_encode()
        words, word = spelt.dictionary, np.repeat(spelt.indices.to_numpy().astype(np.int64), np.concatenate([np.frombuffer(r[1], "<i4") for r in rows]))
        ctx = np.concatenate([np.frombuffer(r[4], "<u8")[np.frombuffer(r[2], "<i4")] for r in rows])
        contexts, ctx = np.unique(ctx, return_inverse=True)
        key, at = np.unique(word * len(contexts) + ctx, return_inverse=True)
        seen = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).astype(np.int64)
        n = np.bincount(at * len(_COUNTS) + seen % len(_COUNTS), weights=seen // len(_COUNTS) + 1, minlength=len(key) * len(_COUNTS)).astype(np.int64).reshape(-1, len(_COUNTS))
        word, ctx = key // len(contexts), contexts[key % len(contexts)]
        own, after = ctx == _OWN, ctx == _NEXT
        pair = ~own & ~after
        has = {(m, y): pair & (n[:, _of(m, y)].sum(1) > 0) for m in _MODELS for y in (0, 1)}
        by = lambda x: np.bincount(word, weights=x, minlength=len(words)).astype(np.int64)
        hashes, some = np.zeros(len(words), np.uint64), word[own]
        hashes[some] = whole_words(words.take(pa.array(some)).to_pylist())
        hashes[[i for i in some.tolist() if words[i].as_py() == b""]] = _BASIS
        h = pa.array(hashes.view(np.int64), mask=~np.isin(np.arange(len(words)), some))
        sums = [*(by(n[:, k] * own) for k in range(len(_COUNTS))), *(by(n[:, k] * after) for k in range(len(_FOLLOW))), *map(by, has.values()), *(by(has[m, 0] | has[m, 1]) for m in _MODELS)]
        yield pa.RecordBatch.from_arrays([words, pa.nulls(len(words), pa.int64()), h, *map(pa.array, sums)], _COUNTED)
        kept = np.flatnonzero(pair & (n.sum(1) >= SEEN))
        none = [pa.array(np.zeros(len(kept), np.int64))] * (len(_COUNTED) - 3 - len(_COUNTS))
        yield pa.RecordBatch.from_arrays([words.take(pa.array(word[kept])), pa.array(ctx[kept].view(np.int64)), pa.nulls(len(kept), pa.int64()), *(pa.array(n[kept, k]) for k in range(len(_COUNTS))), *none], _COUNTED)

    def cut(b):
        for z in range(0, b.num_rows, 20_000):
            yield b.slice(z, 20_000)

    rows, last = [], None
    for b in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and bucket != last:
                for x in flush(rows):
                    yield from cut(x)
                rows = []
            rows.append((*map(zlib.decompress, row[1:]), row[0]))
            last = bucket
    if rows:
        for x in flush(rows):
            yield from cut(x)


def _counted(rows: DataFrame) -> DataFrame:
    """Counts by (word, ctx): with the hash of a preceding word, the labelled texts of a pair that SEEN or more hold; without, those of the word, what follows it, its own hash, and the distinct words that precede it, by model and class."""
    parts = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_merged), "word binary, " + ", ".join(f"{c} long" for c in _COUNTED[1:]))
    return parts.groupBy("word", "ctx").agg(F.max("h").alias("h"), *(F.sum(c).alias(c) for c in _COUNTED[3:]))


def _expand(batches):
    """Counts of each beginning, from sorted words: labelled texts and distinct preceding words, summed over the words that begin so.

    Beginnings seen too rarely, and nowhere else, only add to sums by length: rows without h, in whose columns of preceding
    words stands how many of them each model has seen in each class.
    """
    words, times = [], []
    columns = (*_COUNTS, *_SPREAD, *_TYPES)
    names = ["h", "parent", "depth", *columns]

    def flush():
        of, ends = np.array(times, np.int64).T, {h for w in (words[0], words[-1]) for _, h, _, _ in beginnings([w]) for h in h.tolist()}
        for word, h, parent, depth in beginnings(words):
            found, first, back = np.unique(h, return_index=True, return_inverse=True)
            n = [np.bincount(back, weights=c[word], minlength=len(found)).astype(np.int64) for c in of]
            deep = np.minimum(depth[first], DEPTHS)
            keep = (sum(n[: len(_COUNTS)]) >= SEEN) | np.isin(found, np.fromiter(ends, np.uint64, len(ends)))
            yield [pa.array(found[keep].view(np.int64)), *(pa.array(x[keep]) for x in (parent[first].view(np.int64), deep, *n))]
            rare = [np.bincount(deep[~keep], weights=x[~keep] > 0, minlength=DEPTHS + 1).astype(np.int64) for x in n[len(_COUNTS) : len(_COUNTS) + len(_SPREAD)]]
            at = np.flatnonzero(sum(rare))
            none = np.zeros(len(at), np.int64)
            yield [pa.nulls(len(at), pa.int64()), *map(pa.array, (none, at.astype(np.int32), *[none] * len(_COUNTS), *(x[at] for x in rare), *[none] * len(_TYPES)))]

    for b in batches:
        words += b.column(0).to_pylist()
        times += zip(*(b.column(k + 1).to_pylist() for k in range(len(columns))), strict=True)
        if len(words) >= 30_000:
            yield from (pa.RecordBatch.from_arrays(cols, names) for cols in flush() if len(cols[0]))
            words, times = [], []
    if words:
        yield from (pa.RecordBatch.from_arrays(cols, names) for cols in flush() if len(cols[0]))


def toxic_expressions(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, held_out: int = 2, order: int = 2) -> tuple[DataFrame, ...]:
    """The labels learnt from, and tables of what a word adds by each model (v0, v1, ..., in UNITs), which exceeds MARGIN.

    * (h, v0, ...): by itself, if its longest beginning seen has the hash h; null where a model has not seen it often enough. Those
      that favour toxic by more than MARGIN in a model, and those a byte longer than such that don't (0).
    * (ctx, word, v0, ...): after a word of hash ctx, for pairs that SEEN or more of a model's texts hold (else null); those that
      favour toxic so, and those that don't whose word alone does (0).
    * (ctx, b0, ...): the ratio of the weights by which the classes back off after ctx, which adds to a word's own in other pairs.

    Kneser-Ney of ``order`` 2: a pair's share of the class's pairs after ctx, each count less DISCOUNT, plus what the discounts
    and rarer pairs left times the word's lower order. That is its continuation count, the share of the class's distinct pairs
    that end in it, again discounted; its discounts' weight goes to the backoff that both classes share, the share of distinct
    pairs of either. Words in fewer than SEEN texts are as their longest beginning in so many, whose counts are the sums over
    words that begin so. With ``order`` 1, nothing precedes a word: its counts are texts, the shared ones distinct words, and
    the last two tables are None. All is sums by key and equi joins; no count goes through the driver but those of DEPTHS lengths.
    """
    chosen, rows = _labelled_words(docs, labels, scratch, held_out, order)
    counts = scratch.write(_counted(rows), "counts")
    texts = {(m, y): sum((F.col(_COUNTS[c]) for c in _of(m, y)), F.lit(0)) for m in _MODELS for y in (0, 1)}
    both = {m: texts[m, 0] + texts[m, 1] for m in _MODELS}
    vocabulary = counts.where("ctx is null and length(word) > 0").select("word", "h", *_COUNTS, *_SPREAD, *_TYPES)
    if order == 1:
        vocabulary = vocabulary.select("word", "h", *_COUNTS, *(n.alias(f"c{m}{y}") for (m, y), n in texts.items()), *((both[m] > 0).cast("long").alias(f"t{m}") for m in _MODELS))
    columns = (*_COUNTS, *_SPREAD, *_TYPES)
    raw = vocabulary.drop("h").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(lean(_expand), "h long, parent long, depth int, " + ", ".join(f"{c} long" for c in columns))
    nodes = scratch.write(raw.groupBy("h", "depth").agg(F.min("parent").alias("parent"), *(F.sum(c).alias(c) for c in columns)), "beginnings")
    size = vocabulary.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_SPREAD, *_TYPES))).first()
    kinds = nodes.groupBy("depth").agg(*(F.sum(F.when(F.col("h").isNull(), F.col(c)).otherwise((F.col(c) > 0).cast("long"))).alias(c) for c in _SPREAD))
    kinds = {r.depth: r for r in kinds.collect()}
    learnt = {m: min(size[f"c{m}0"], size[f"c{m}1"]) > 0 for m in _MODELS}

    def alone(m: int, y: int) -> Column:
        """P(a word begins so | class): discounted continuation counts, and the discounts spread over those of both classes."""
        c, of = f"c{m}{y}", size[f"c{m}{y}"]
        weights = [DISCOUNT * max(1, kinds[d][c] if d in kinds else 0) / of for d in range(1, DEPTHS + 1)]
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / of + F.element_at(F.array(*map(F.lit, weights)), F.col("depth")) * F.greatest(F.col(f"t{m}"), F.lit(1)) / size[f"t{m}"]

    def excess(m: int, p: list[Column]) -> Column:
        return F.greatest(F.round((F.log(p[1] / p[0]) - MARGIN) * UNIT).cast("long"), F.lit(0))

    def own(m: int) -> Column:
        return excess(m, [alone(m, y) for y in (0, 1)]) if learnt[m] else F.lit(0).cast("long")

    seen = nodes.where(F.col("h").isNotNull()).select("h", "parent", *(F.when(both[m] >= SEEN, own(m)).alias(_VALUES[m]) for m in _MODELS)).where("v0 is not null")
    most = F.greatest(*_VALUES)  # of those that are known
    toxic = seen.where(most > 0)
    rest = seen.where(most <= 0).join(toxic.select(F.col("h").alias("parent")), "parent", "left_semi")
    table = scratch.write(toxic.unionByName(rest).select("h", *_VALUES), "toxic")
    pairs = after = None
    if order > 1:
        kept = counts.where("ctx is not null").select("word", "ctx", *_COUNTS)
        follow = {(m, y): sum((F.col(_FOLLOW[c]) for c in _of(m, y)), F.lit(0)) for m in _MODELS for y in (0, 1)}
        less = {(m, y): F.greatest(n - DISCOUNT, F.lit(0.0)) for (m, y), n in texts.items()}
        after = kept.groupBy("ctx").agg(*(F.sum(F.when(both[m] >= SEEN, x).otherwise(0.0)).alias(f"s{m}{y}") for (m, y), x in less.items()))
        after = after.join(counts.where("h is not null").select(F.col("h").alias("ctx"), *_FOLLOW), "ctx")
        after = after.select("ctx", *(f.alias(f"f{m}{y}") for (m, y), f in follow.items()), *(F.when(f > 0, 1 - F.col(f"s{m}{y}") / f).otherwise(1.0).alias(f"l{m}{y}") for (m, y), f in follow.items()))
        after = scratch.write(after, "contexts")
        known = vocabulary.select("word", "h", F.least(F.length("word") + 1, F.lit(DEPTHS)).alias("depth"), *_SPREAD, *_TYPES)
        known = known.select("word", F.col("h").alias("hash"), *(alone(m, y).alias(f"p{m}{y}") if learnt[m] else F.lit(1.0).alias(f"p{m}{y}") for m in _MODELS for y in (0, 1)), *(own(m).alias(f"o{m}") for m in _MODELS))
        p = {(m, y): less[m, y] / F.greatest(F.col(f"f{m}{y}"), F.lit(1)) + F.col(f"l{m}{y}") * F.col(f"p{m}{y}") for m in _MODELS for y in (0, 1)}
        pairs = kept.join(known, "word").join(after, "ctx")
        pairs = pairs.select("ctx", F.col("hash").alias("word"), *(F.when(both[m] >= SEEN, excess(m, [p[m, 0], p[m, 1]]) if learnt[m] else F.lit(0)).cast("long").alias(_VALUES[m]) for m in _MODELS), F.greatest(*(f"o{m}" for m in _MODELS)).alias("own"))
        pairs = scratch.write(pairs.where((most > 0) | (F.col("own") > 0)).drop("own"), "pairs")
        weights, after = after, scratch.write(after.select("ctx", *(F.round(F.log(F.col(f"l{m}1") / F.col(f"l{m}0")) * UNIT).cast("long").alias(f"b{m}") for m in _MODELS)), "after")
        scratch.drop(weights)
    scratch.drop(counts, nodes)
    return chosen, table, pairs, after


def toxic_beginnings(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, held_out: int = 2) -> tuple[DataFrame, DataFrame]:
    """The first two of ``toxic_expressions`` by order 1: the labels learnt from, and what words add by themselves."""
    return toxic_expressions(docs, labels, scratch, held_out=held_out, order=1)[:2]


def _hits(bits, pair_bits):
    """A row for each text (key, size, and hash, preceding hash and number of each of its words that may begin as in the table, or may stand so among the pairs), and for each word of the first kind its beginnings that may be in the table. Without pairs, preceding hashes are 0."""

    def run(batches):
        for b in batches:
            texts = [words_of(x) for x in b.column(1).to_pylist()]
            flat = pa.array([w for ws in texts for w in ws], pa.binary()).dictionary_encode()
            words, index = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
            whole, some, found = np.append(np.zeros(len(words), np.uint64), _BASIS), np.zeros(len(words), bool), []
            for word, h, _, depth in beginnings(words):
                whole[word] = h  # the last that is written is the whole word's
                at = passes(bits.value, h)
                some[word[at]] = True
                found.append((word[at], h[at], depth[at]))
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            doc, on, wide = np.repeat(np.arange(len(texts)), size), some[index], len(words) + 1
            before = np.full(len(index), len(words), np.int64)
            if pair_bits:
                before[1:] = index[:-1]
                before[(np.cumsum(size) - size)[size > 0]] = len(words)  # the start of a text
                on |= passes(pair_bits.value, pair_hash(whole[before], whole[index]))
            else:
                whole[-1] = 0
            pair, n = np.unique((doc[on] * wide + before[on]) * wide + index[on], return_counts=True)
            doc, before, word = pair // wide**2, pair // wide % wide, pair % wide
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32()), pa.array(x, pa.int64()))
            empty = lambda n, t: pa.nulls(n, t)
            k = len(texts)
            of_text = (lists(whole[word].view(np.int64)), lists(whole[before].view(np.int64)), lists(n))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), *of_text, empty(k, pa.int64()), empty(k, pa.int32()), empty(k, pa.int64())], _HIT_NAMES)
            word, h, depth = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
            for at in range(0, len(word), 50_000):
                z = slice(at, at + 50_000)
                k = len(word[z])
                yield pa.RecordBatch.from_arrays([empty(k, pa.binary()), empty(k, pa.int64()), *(empty(k, pa.list_(pa.int64())) for _ in range(3)), pa.array(whole[word[z]].view(np.int64)), pa.array(depth[z]), pa.array(h[z].view(np.int64))], _HIT_NAMES)

    return run


_HIT_NAMES = ["key", "size", "words", "before", "times", "word", "depth", "h"]


def pair_hash(ctx: np.ndarray | Column, word: np.ndarray | Column) -> np.ndarray | Column:
    """One 64-bit hash of two, in Python or as a column."""
    if isinstance(word, Column):
        return ctx.bitwiseXOR(F.shiftleft(word, 21).bitwiseOR(F.shiftrightunsigned(word, 43)))
    return ctx ^ (word << np.uint64(21) | word >> np.uint64(43))


def evidence(docs: DataFrame, table: DataFrame, scratch: Scratch, pairs: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """(key, size, v0, v1, ...): for each distinct text (key: its MD5) with such words, each model's sum over its words, in UNITs, and the number of its words.

    A word adds what its pair with the preceding one does, if a model knows it; else, if its own ratio exceeds MARGIN, what that
    and the ratio of the backoff weights together exceed it by.
    """
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(bit_filter(table, "h"))
    pair_bits = context.broadcast(bit_filter(pairs.select(pair_hash(F.col("ctx"), F.col("word")).alias("h")), "h")) if pairs is not None else None
    text, path = F.col("text").cast("binary"), scratch.path("hits")
    hits = docs.where(F.length(text) > 0).select(_key(), text.alias("text")).mapInArrow(lean(_hits(bits, pair_bits)), "key binary, size long, words array<long>, before array<long>, times array<long>, word long, depth int, h long")
    with small_batches(docs.sparkSession):
        hits.where("key is null or size(words) > 0").withColumn("kind", F.when(F.col("key").isNull(), "word").otherwise("text")).write.partitionBy("kind").parquet(path)
    bits.unpersist()
    if pair_bits:
        pair_bits.unpersist()
    hits = docs.sparkSession.read.schema(hits.schema.add("kind", "string")).parquet(path)
    found = hits.where("kind = 'word'").select("word", "depth", "h").distinct().join(table, "h")
    best = lambda c: F.coalesce(F.max(F.when(F.col(c).isNotNull(), F.struct("depth", c)))[c], F.lit(0)).alias(c)  # noqa: E731  the longest beginning that the model has
    values = scratch.write(found.groupBy("word").agg(*map(best, _VALUES)).where(F.greatest(*_VALUES) > 0), "values")
    texts = hits.where("kind = 'text'").select("key", "size", "words", "before", "times")
    each = lambda t: t.select("key", "size", F.explode(F.arrays_zip("words", "before", "times")).alias("x")).select("key", "size", F.col("x.words").alias("word"), F.col("x.before").alias("ctx"), F.col("x.times").alias("times"))
    by = ["word"]
    if pairs is not None:
        by = ["word", "ctx"]
        said = pairs.select("ctx", "word", *(F.col(v).alias(f"p{v}") for v in _VALUES))
        stand = each(texts).select(*by).distinct().join(values, "word", "left").join(said, by, "left").join(after, "ctx", "left")
        backed = lambda m, v: F.when(F.col(v) > 0, F.greatest(F.col(v) + F.coalesce(f"b{m}", F.lit(0)), F.lit(0))).otherwise(0)
        stand = stand.select(*by, *(F.coalesce(f"p{v}", backed(m, v)).alias(v) for m, v in enumerate(_VALUES))).where(F.greatest(*_VALUES) > 0)
        alone, values = values, scratch.write(stand, "stand")
        scratch.drop(alone)
    texts = each(texts.dropDuplicates(["key"])).join(values, by)
    out = scratch.write(texts.groupBy("key").agg(F.max("size").alias("size"), *(F.sum(F.col(v) * F.col("times")).alias(v) for v in _VALUES)), "evidence")
    scratch._delete(path)
    scratch.drop(values)
    return out


def _key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")


def _features(total: Column | np.ndarray, size: Column | np.ndarray, sqrt, order: int = 1) -> list:
    """Of a text's evidence by the word; with single words, of its whole evidence, too."""
    mean = total / size
    return [sqrt(mean), mean, *([sqrt(total)] if order == 1 else [])]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant first, of the ridge regression on standardised features, none but the constant below 0: more evidence never lowers a score.

    The loss is strictly convex, and each Newton step is halved until it descends. While a weight is negative, the feature
    with the least one goes. With one class only, the constant is its smoothed share.
    """
    w = np.zeros(x.shape[1] + 1)
    share = (y.sum() + 1) / (len(y) + 2)
    w[0] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return w
    on = list(range(x.shape[1]))
    while True:
        some = _fitted(x[:, on], y, ridge)
        if len(on) == 0 or some[1:].min() >= 0:
            w = np.zeros(x.shape[1] + 1)
            w[[0, *(k + 1 for k in on)]] = some
            return w
        on.pop(int(np.argmin(some[1:] * np.maximum(x[:, on].std(0), 1e-9))))


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z, sign = np.column_stack([np.ones(len(x)), (x - mean) / scale]), 2 * y - 1
    keep, w = ridge * np.diag([0.0] + [1.0] * x.shape[1]), np.zeros(x.shape[1] + 1)
    loss = lambda w: np.logaddexp(0, -sign * (z @ w)).sum() + 0.5 * w @ keep @ w
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(0.5 * (z @ w)))
        down = z.T @ (y - p) - keep @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep + 1e-9 * np.eye(len(w)), down)
        size = 1.0
        while loss(w + size * step) > loss(w) - 1e-4 * size * (down @ step) and size > 1e-9:
            size /= 2
        w = w + size * step
        if np.abs(down).max() < 1e-7 * len(y):
            break
    return np.concatenate([[w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale])


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, held_out: int = 2, cut: float = CUT, rows: int = CALIBRATION_ROWS, columns: list[str] | None = None, order: int = 1) -> DataFrame:
    """All columns of ``docs``, or those in ``columns``, in a struct ``row``, with ``score`` (0 to 1) and ``predicted`` (1 if score >= cut).

    A word's evidence is how far its log-likelihood as toxic exceeds that as ordinary by more than MARGIN; a text's is its
    words' sum, normalised by their number. With ``order`` 2 a word's likelihood is that after the word before it, and with 1
    that by itself; then the whole sum enters, too. The weights that turn it into a probability are fitted on the labelled rows of
    the folds of crc32(doc_id) mod 4 but ``held_out``, each judged by the model of the other two, over the ``rows`` rows of
    smallest hash of doc_id at most; the scores' model has seen all three. Every row gets a score, also for a null or empty
    text (no evidence); equal texts get equal scores. Labels and all columns but text never enter it. Labels without a doc_id
    or value don't count; if those of a doc_id disagree, the larger holds, and its repeated rows count each. No labelled rows
    give every text the same score; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen, table, pairs, after = toxic_expressions(docs, labels, scratch, held_out=held_out, order=order)
    found = evidence(docs, table, scratch, pairs, after)
    some = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key())
    other = F.element_at(F.array(*_VALUES[1:]), F.col("fold") + 1)
    known = keyed.join(some, "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("key").alias("key")).join(found, "key", "left").select("toxic", F.coalesce(other, F.lit(0)).alias("v"), F.coalesce("size", F.lit(1)).alias("size")).toPandas()
    x = np.column_stack(_features(known["v"].to_numpy(float) / UNIT, known["size"].to_numpy(float), np.sqrt, order)) if len(known) else np.zeros((0, len(_features(0.0, 1.0, np.sqrt, order))))
    weights = logistic(x, known["toxic"].to_numpy(int)).tolist()
    scratch.drop(table, chosen, *(x for x in (pairs, after) if x is not None))
    total = F.coalesce(F.col("v0"), F.lit(0)) / UNIT
    z = F.lit(weights[0])
    for w, f in zip(weights[1:], _features(total, F.coalesce(F.col("size"), F.lit(1)), F.sqrt, order), strict=True):
        z = z + w * f
    out = docs.select(as_row(docs.select(columns or docs.columns)), _key()).join(found.select("key", "size", "v0"), "key", "left").select("row", (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    crc = F.crc32(F.col("row.doc_id").cast("string").cast("binary"))
    return toxicity_scores(docs, labels, columns=["doc_id"], order=2).select("row.doc_id", F.coalesce(crc % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")
