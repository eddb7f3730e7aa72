"""Personal data: fixed patterns as seeds, and lexical contexts bootstrapped from them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns. Possessive repeats and look-behinds only save time: what matches is what the plain patterns match
#: from left to right without overlap (a local part, an address or a run of digits is never entered in its middle, and a
#: run of digits is taken whole, so that only runs of 12 to 19 digits are returned at all).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: An unseen identifier's form, after a blank or an opening mark: groups of digits joined by single blanks, or a run that holds
#: a digit and ends in a letter or digit; in either case with DIGITS digits or more. Possessive repeats keep it linear.
_OPEN, _RUN = r"(?<![^\s(\[<\"'=:,;])", r"[^\s\"'<>()\[\],;=:"
IDENTIFIER = _OPEN + r"(?:\+?[0-9][0-9./-]*+(?: [0-9](?:[0-9./-]*[0-9])?(?![^\s\"'<>()\[\],;=:.!?]))++|(?=" + _RUN + r"0-9]*+[0-9])" + _RUN + r"]*[A-Za-z0-9])"
DIGITS = 4
#: A pattern is the two words before an identifier; it is trusted from this share of known instances on, and this many of them.
TRUST, SUPPORT, ROUNDS = 0.8, 5, 3
#: The same, read backwards from the identifier.
_CONTEXT = r"^[\"'(\[<]?\s*+(\S++\s++\S++)"
_BLOCK = 128


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once; a lambda would compute it for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """array<bigint> of the sums of array<bigint> up to each element. Sums of blocks first: appending one by one to a whole array would take its square."""
    empty = F.array().cast("array<bigint>")

    def appended(acc, x):
        at = acc["at"] + x
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def block(acc, some):
        return let(F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), appended), lambda z: F.struct(z["at"].alias("at"), F.concat(acc["out"], F.array(z["out"])).alias("out")))

    def whole(a):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda k: F.slice(a, k * _BLOCK + 1, F.lit(_BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out")), block, lambda acc: acc["out"]))

    return let(numbers, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(empty))


def _pieces(text: Column, pattern: str) -> Column:
    """array<struct<g, v>>: the text before each match and the match; last the text after all, with a null."""
    return let(text, lambda t: F.transform(F.arrays_zip(F.split(t, pattern, -1).alias("g"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("v")), lambda x: F.struct(x["g"].alias("g"), x["v"].alias("v"))))


def found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v, c>>: start and end (code points, exclusive), text and context of each match, in time linear in the text.

    The context is the last two words before a match, in lower case and digits as 0, looked for as far back as the last match
    but one; empty if there are fewer.
    """

    def placed(pieces):
        matches = F.slice(pieces, 1, F.size(pieces) - 1)
        ends = running_sums(F.transform(matches, lambda x: (F.length(x["g"]) + F.length(x["v"])).cast("bigint")))
        before = F.concat(F.array(F.lit("")), F.transform(matches, lambda x: F.concat(x["g"], x["v"])))
        rows = F.zip_with(F.zip_with(matches, F.slice(before, 1, F.size(pieces) - 1), lambda x, p: F.struct(x["g"].alias("g"), x["v"].alias("v"), p.alias("p"))), ends, lambda x, e: F.struct(x.alias("x"), e.alias("e")))
        return F.transform(rows, lambda r: F.struct((r["e"] - F.length(r["x"]["v"])).cast("int").alias("s"), r["e"].cast("int").alias("e"), r["x"]["v"].alias("v"), _before(F.concat(r["x"]["p"], r["x"]["g"])).alias("c")))

    return let(_pieces(text, pattern), placed)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits from the right, every second one doubled (9 less beyond 9), sum to a multiple of ten."""
    parts = F.split(F.reverse(_digits(v)), "")
    total = F.aggregate(
        F.transform(F.filter(parts, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, d: a + d,
    )
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<s:int,k:int,e:int,v:string,c:string>>"


def _hinted(kind: str, text: Column) -> Column:
    """Whether a text may hold a match at all."""
    hint = text.contains(_HINT[kind]) if _HINT[kind] else F.lit(True)
    return hint if kind == "email" else hint & text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, v, c>> of the fixed patterns, by start and then kind (k: its place in KINDS)."""

    def of(k: int, kind: str) -> Column:
        kept = F.filter(found(text, PATTERNS[kind]), lambda x: _valid(kind, x["v"]))
        spans = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v"), x["c"].alias("c")))
        return F.when(_hinted(kind, text), spans).otherwise(F.array().cast(_SPAN))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _without(kind: str):
    """The text with a line feed for each letter of what a fixed pattern finds."""
    blank = lambda x: F.concat(x["g"], F.when(x["v"].isNull(), "").when(_valid(kind, x["v"]), F.repeat(F.lit("\n"), F.length(x["v"]))).otherwise(x["v"]))
    return lambda t: F.when(_hinted(kind, t), F.array_join(F.transform(_pieces(t, PATTERNS[kind]), blank), "")).otherwise(t)


def blanked(text: Column) -> Column:
    """The text without what the fixed patterns find, one kind after the other; all else stays where it is."""
    for kind in KINDS:
        text = let(text, _without(kind))
    return text


def _before(left: Column) -> Column:
    """The last two words of a text, in lower case, digits as 0; empty if there are none. It is read backwards, so that no start is tried twice."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.reverse(F.regexp_extract(F.reverse(left), _CONTEXT, 1))), r"\s+", " "), "[0-9]+", "0")


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def trusted_patterns(mentions: DataFrame, scratch: Scratch, *, trust: float = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind) trusted after ``rounds`` of scoring the graph of contexts and instances ``mentions`` (context, value, kind or null).

    A context's score for a kind is the sum of its distinct instances' scores over their number and one; an instance's score
    is 1 for its own kind if it is a seed, else one minus the product of (1 - score) over its trusted contexts. Only sums by
    key and equi joins of written tables are used, so a context or value of any frequency spreads over tasks.
    """
    edges = scratch.write(mentions.where("context <> ''").groupBy("context", "value").agg(F.max("kind").alias("kind")), "edges")
    total = edges.groupBy("context").agg(F.count("*").alias("total"))
    seeds = edges.where("kind is not null").select("context", "value", "kind", F.lit(1.0).alias("score"))
    scored, patterns = seeds, None
    for k in range(rounds):
        hits = scored.groupBy("context", "kind").agg(F.sum("score").alias("hits")).where(F.col("hits") >= support)
        patterns = scratch.write(hits.join(total, "context").withColumn("score", F.col("hits") / (F.col("total") + 1)).where(F.col("score") >= trust).select("context", "kind", "score"), "patterns")
        if k + 1 == rounds or patterns.isEmpty():
            break
        fresh = edges.where("kind is null").select("context", "value").join(patterns, "context").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score"))
        fresh = scratch.write(fresh, "instances")
        scored = seeds.unionByName(edges.where("kind is null").select("context", "value").join(fresh, "value").select("context", "value", "kind", "score"))
    best = patterns.groupBy("context").agg(F.max(F.struct("score", F.lit(0) - F.col("kind"))).alias("b"))
    return best.select("context", (-F.col("b")["col2"]).alias("kind"))


def private_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, trust: float = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, spans): arrays of (s, k, e, v, c: context) for each row: the fixed patterns', and those with what trusted contexts add.

    An identifier that follows a trusted context gets that context's kind; identifiers are looked for in the text whose base
    spans are blanked, of any length and at any distance from the last one. A null or empty text has no spans; repeated rows are rows like others; an empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    more = F.filter(found(blanked(F.col("text")), IDENTIFIER), lambda x: (x["c"] != "") & (F.length(_digits(x["v"])) >= DIGITS))
    more = F.when(F.col("text").rlike("[0-9]"), more).otherwise(F.array().cast("array<struct<s:int,e:int,v:string,c:string>>"))
    rows = scratch.write(rows.select("row", "doc_id", base_spans(F.col("text")).alias("base"), more.alias("more")), "spans")
    seeds = rows.select(F.explode("base").alias("x")).select(F.col("x.c").alias("context"), F.lower("x.v").alias("value"), F.col("x.k").alias("kind"))
    others = rows.select("row", F.explode("more").alias("x")).select("row", "x.s", "x.e", "x.v", F.col("x.c").alias("context"))
    mentions = seeds.unionByName(others.select("context", F.lower("v").alias("value"), F.lit(None).cast("int").alias("kind")))
    patterns = scratch.write(trusted_patterns(mentions, scratch, trust=trust, support=support, rounds=rounds), "trusted")
    new = others.join(patterns, "context").groupBy("row").agg(F.collect_list(F.struct("s", F.col("kind").alias("k"), "e", "v", F.col("context").alias("c"))).alias("new"))
    out = rows.select("row", "doc_id", "base").join(scratch.write(new, "new"), "row", "left")
    return scratch.keep(out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(_SPAN)))).alias("spans")))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    out = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *map(n, range(4)), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
