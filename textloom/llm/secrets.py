"""Secrets: fixed patterns, and strings that a Markov model of random strings explains better than one of identifiers."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch, as_row, row_schema, small_batches

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_MIXED = re.compile(r"[a-z][A-Z]")
#: The models' letters; 0 stands for any other byte.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
SIZE = len(ALPHABET) + 1
#: Labelled random strings that are made for training, and the log-likelihood ratio a letter from which a string is a secret: with two digits or more, and with fewer.
MADE, CUT, FEW_CUT = 4000, 0.75, 2.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within each kind; failing matches are dropped."""
    out, low = [], text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _pairs(raw: bytes) -> np.ndarray:
    """Counts of adjacent letters, as (SIZE * SIZE); a letter outside the alphabet ends a string."""
    code = _CODE[np.frombuffer(raw, np.uint8)]
    code = np.concatenate([[0], code, [0]])
    return np.bincount(code[:-1] * SIZE + code[1:], minlength=SIZE * SIZE)


def made_strings(n: int = MADE, seed: int = 7) -> list[bytes]:
    """Labelled random strings: letters drawn evenly from the usual encodings of keys, 16 to 64 long."""
    draw, sets = np.random.default_rng(seed), ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:26] + "234567", ALPHABET[:62] + "_-"]
    return [bytes(draw.choice(np.frombuffer(sets[k % len(sets)].encode(), np.uint8), draw.integers(16, 65))) for k in range(n)]


@dataclass
class Markov:
    """log P(next letter | letter) of random strings minus that of ordinary identifiers; (SIZE, SIZE)."""

    ratio: np.ndarray

    def rate(self, token: str) -> float:
        """The log-likelihood ratio of a string, a letter."""
        code = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratio[code[:-1], code[1:]].mean()) if len(code) > 1 else 0.0


def _log(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell: each row backs off to the letters' own shares, and those to an even one."""
    c = counts.reshape(SIZE, SIZE).astype(float)
    c[:, 0] = 0
    one = c[1:].sum(0)
    one = (one + 0.5 * (np.arange(SIZE) > 0)) / (one.sum() + 0.5 * (SIZE - 1))
    kinds = (c > 0).sum(1, keepdims=True) + 1
    return np.log(np.maximum((c + kinds * one) / (c.sum(1, keepdims=True) + kinds), 1e-12))


def train(docs: DataFrame, text: str = "text") -> Markov:
    """Fits both models over all documents.

    Labelled by the fixed patterns: keys and hexadecimal strings that they match are random strings, all other letters of
    the corpus, but for candidates with two digits or a capital after a small letter, are ordinary identifiers; to the former the made strings are added. Each task sends two tables of SIZE * SIZE sums at most.
    """

    def count(batches):
        random, plain = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    at, rest = 0, []
                    for s, e, kind in sorted([*base_spans(x), *((s, e, "candidate") for s, e in candidates(x) if _digits(x[s:e]) >= 2 or _MIXED.search(x, s, e))]):
                        if kind in ("access", "hex"):
                            random += _pairs(x[s:e].encode())
                        if s >= at:
                            rest.append(x[at:s])
                        at = max(at, e)
                    plain += _pairs("\0".join([*rest, x[at:]]).encode())
        for kind, n in (("random", random), ("plain", plain)):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["kind", "pair", "n"])

    sums = docs.select(text).mapInArrow(count, "kind string, pair long, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()
    random, plain = np.zeros(SIZE * SIZE), np.zeros(SIZE * SIZE)
    for kind, pair, n in sums:
        (random if kind == "random" else plain)[pair] += n
    made = sum(_pairs(x) for x in made_strings())
    random = made + random * min(1.0, made.sum() / max(1, random.sum()))
    return Markov(_log(random) - _log(plain))


def _digits(token: str) -> int:
    return sum(c.isdigit() for c in token)


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings of 16 letters of the alphabet or more, with a letter, without marks at their ends."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m.group().rstrip("-_=")
        s = m.end() - len(m.group().lstrip("-_=+/"))
        token = text[s : m.start() + len(token)]
        if len(token) >= 16 and any(c.isalpha() for c in token):
            out.append((s, s + len(token)))
    return out


def _united(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union."""
    starts, ends = [], []
    for s, e, _ in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def random_spans(text: str, model: Markov, taken: list[tuple[int, int, str]], cut: float = CUT) -> list[tuple[int, int, str]]:
    """Candidates outside the spans in ``taken`` that the random model favours by ``cut`` a letter, or by FEW_CUT if they have fewer than two digits."""
    starts, ends = _united(taken)
    free = lambda s, e: not (k := bisect_left(starts, e)) or ends[k - 1] <= s
    return [(s, e, "random") for s, e in candidates(text) if free(s, e) and model.rate(text[s:e]) >= (cut if _digits(text[s:e]) >= 2 else max(cut, FEW_CUT))]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def secret_spans(docs: DataFrame, text: str = "text", *, cut: float = CUT, columns: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, or those in ``columns``, in a struct ``row``, with n_assign, n_access, n_hex, base (joined spans) and spans (base ones and those the models add).

    A null or empty text has no spans. Positions are code points, ends exclusive. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    with small_batches(docs.sparkSession):
        model = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                base = base_spans(x) if x else []
                out.append((*(sum(k == kind for _, _, k in base) for kind in KINDS[:3]), _joined(base), _joined(base + (random_spans(x, model.value, base, cut) if x else []))))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["row", "n_assign", "n_access", "n_hex", "base", "spans"])

    rows = docs.select(as_row(docs.select(columns or docs.columns)), F.col(text).alias("text"))
    return scratch.keep(rows.mapInArrow(run, row_schema(rows, "n_assign long, n_access long, n_hex long, base string, spans string")))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), columns=["doc_id"])
    return out.select("row.doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
