"""Resampling towards a target distribution: gains of hashed n-grams, one random number a document, the highest sums drawn."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.scratch import Scratch
from textloom.llm.toxicity import words_of

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: A feature with this share of all occurrences is looked up in a table of 1 / share rows at most, of features of so many bytes at most.
HEAVY, HEAVY_BYTES = 2e-5, 64
_NAMES = ["k", "id", "n_words", "n_features", "features", "times"]
_TYPES = "k long, id long, n_words long, n_features long, features array<string>, times array<long>"


def n_grams(words: list[bytes], longest: int) -> Iterator[bytes]:
    for n in range(1, longest + 1):
        yield from (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) if n > 1 else words


def feature_counts(docs: DataFrame, id: str, text: str, longest: int) -> DataFrame:
    """A row for each row of ``docs``: a number of its own (k), its id, how many words and features it has, and each distinct feature with its count. Counted within the text, so without a shuffle."""

    def run(batches):
        k = TaskContext.get().partitionId() << 33
        for b in batches:
            words = [words_of(x) for x in b.column(1).to_pylist()]
            counts = [Counter(n_grams(w, longest)) for w in words]
            lists = lambda values, kind: pa.array(values, pa.list_(kind))
            n = len(words)
            features = lists([list(c) for c in counts], pa.binary()).cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(range(k, k + n), pa.int64()), b.column(0), pa.array(map(len, words), pa.int64()), pa.array([c.total() for c in counts], pa.int64()), features, lists([list(c.values()) for c in counts], pa.int64())], _NAMES)
            k += n

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary")).mapInArrow(run, _TYPES)


def _exploded(counts: DataFrame) -> DataFrame:
    return counts.select("k", F.explode(F.arrays_zip("features", "times")).alias("x")).select("k", F.col("x.features").alias("feature"), F.col("x.times").alias("times"))


def dictionary(counts: DataFrame, buckets: int) -> DataFrame:
    """(feature, n, bucket): each distinct string once, its occurrences in all texts, and its bucket."""
    strings = _exploded(counts).groupBy("feature").agg(F.sum("times").alias("n"))
    return strings.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def _gain(buckets: int, all_s: int, all_t: int) -> Column:
    d = lambda x: (F.lit(x) if isinstance(x, int) else F.col(x)).cast("double")
    return F.floor(1000 * F.log(((d("t") + 1) * d(all_s + buckets)) / ((d("s") + 1) * d(all_t + buckets))))


def weighted(docs: DataFrame, target: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(k, id, n_words, n_features, weight): the floored mean of the gains of a document's features.

    Strings are counted over all texts, each distinct one is hashed once, and counts are summed by bucket. The gains then go
    back to the strings and, by an equi join on the string, to the documents' own counts. As all shares sum to 1, at most
    1 / HEAVY strings have a share of HEAVY or more: these are broadcast, so that no string that meets in the shuffle has
    more than that share, whatever the data; what is left of the shuffle are the rare strings.
    """
    counts = scratch.write(feature_counts(docs, id, text, longest), "counts", compression="zstd")
    strings = scratch.write(dictionary(counts, buckets), "strings")
    aims = dictionary(feature_counts(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text, longest), buckets)
    sums = scratch.write(strings.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(aims.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    all_s, all_t = (int(x or 0) for x in sums.agg(F.sum("s"), F.sum("t")).first())
    gains = sums.select("bucket", _gain(buckets, all_s, all_t).alias("gain"))  # as many rows as buckets at most
    known = scratch.write(strings.join(F.broadcast(gains), "bucket").select("feature", "gain", ((F.col("n") >= HEAVY * all_s) & (F.octet_length("feature") <= HEAVY_BYTES)).alias("heavy")), "gains")
    scratch.drop(strings, sums)
    heavy = F.broadcast(known.where("heavy").select("feature", "gain"))
    each = _exploded(counts)
    common = each.join(heavy, "feature").groupBy("k").agg(F.sum(F.col("gain") * F.col("times")).alias("gain"))
    rare = each.join(heavy, "feature", "left_anti").join(known.where("not heavy").hint("merge"), "feature").groupBy("k").agg(F.sum(F.col("gain") * F.col("times")).alias("gain"))
    none = F.lit(None).cast("long")
    gained = [x.select("k", none.alias("id"), none.alias("n_words"), none.alias("n_features"), "gain") for x in (common, rare)]
    rows = counts.select("k", "id", "n_words", "n_features", none.alias("gain")).unionByName(gained[0]).unionByName(gained[1])
    rows = rows.groupBy("k").agg(*(F.max(c).alias(c) for c in ("id", "n_words", "n_features")), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    return rows.select("k", "id", "n_words", "n_features", F.expr("if(n_features = 0, 0L, (gain - pmod(gain, n_features)) div n_features)").alias("weight"))


def noise(id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variate, floored, from 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scores: DataFrame, scratch: Scratch, percent: int, least_words: int) -> DataFrame:
    """``scores`` with the rank of those drawn.

    Scores are whole thousandths of sums of two logarithms, of which there are some 150,000 at any size of the data, so that
    counts by score are a small table; it gives each score the documents before it and tells where to stop. Only those that
    reach that score are put in order, within their score; random numbers spread any group over thousands of scores.
    """
    fit = F.col("n_words") >= least_words
    by_score = scores.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    before = scratch.write(by_score.select("score", "n", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before")), "scores")
    draw = percent * int(before.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 100
    last = before.where(F.col("before") < draw).agg(F.min("score")).first()[0]
    reach = fit & (F.col("score") >= (last if last is not None else 0)) & F.lit(last is not None)
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "k"))
    drawn = scores.where(reach).join(before.select("score", "before"), "score").withColumn("rank", (F.col("before") + within).cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(*scores.columns, "rank")
    return drawn.unionByName(scores.where(~reach).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each row of ``docs``: id, n_features, weight, score, and rank, which is null unless the document is drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn: those of the highest weight plus
    Gumbel noise, which is a draw without replacement in proportion to exp(weight / 1000). Ties go to the smaller id, a null
    id last; repeated rows count each. A null or wordless text has weight 0 and is never drawn. An empty target makes rare
    features the gainful ones; an empty table gives an empty one. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    rows = weighted(docs, target, scratch, id=id, text=text, target_text=target_text, longest=longest, buckets=buckets)
    scores = scratch.write(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    out = ranked(scores, scratch, percent, least_words)
    return scratch.keep(out.select(F.col("id").alias(id), "n_features", "weight", "score", "rank"))


def op11_resample(spark, sf_dir: str) -> DataFrame:
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH tbl AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, q: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tbl FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda p: (strpos('0123456789ABCDEF', x[p]) - 1) * 16 + strpos('0123456789ABCDEF', x[p + 1]) - 1)), lambda c, q: xor(c >> 8, tbl[xor(c, q) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket FROM v, tbl),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM dw JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bw JOIN h USING (word) GROUP BY bucket),
g AS (SELECT word, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain FROM h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN g USING (word) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)
"""
