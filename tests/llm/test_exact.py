import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import make_docs
from textloom.llm import exact
from textloom.llm.scratch import Scratch


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()


def check(pairs, df):
    got, groups = df.collect(), {}
    for i, x in pairs:
        groups.setdefault(plain(x), []).append(i)
    least = {x: min((i for i in ids if i is not None), default=None) for x, ids in groups.items()}
    want = sorted(((i, least[plain(x)], len(groups[plain(x)]), hashlib.sha256(plain(x)).hexdigest()) for i, x in pairs), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def corpus(prose):
    draw, texts = random.Random(8), [prose(n, n) for n in range(1, 80)]
    blank = lambda x: re.sub(" ", lambda _: draw.choice([" ", "\t", "  ", "\n\r", "\x0b\x0c"]), x)
    pairs = [(k, blank(draw.choice(texts))) for k in range(400)] + [(1000 + k, prose(30, 5)) for k in range(300)]
    pairs += [(400, None), (401, ""), (402, " "), (403, "\n\t"), (404, " a"), (405, "a"), (406, "a "), (407, "\ta"), (408, "a b"), (409, "a b"), (410, "word " * 100_000), (411, "word\n" * 100_000)]
    return pairs + [(None, texts[0]), (7, texts[3]), (7, texts[3]), (None, "only null"), (None, "only null"), (-5, texts[4]), (0, "zero"), (None, "zero")]


def test_normalised(prose):
    for text in (None, "", " ", "\t\n", "a", " a", "a ", " a \x0b b\r\n", "a\x1cb\x85  c", prose(50, 1)):
        assert exact.normalised(None if text is None else text.encode()) == plain(text)


@pytest.mark.parametrize(("capacity", "key_bits", "held"), [(1 << 24, 64, 1 << 24), (2000, 64, 3000), (2000, 3, 0), (500, 0, 1 << 24)])
def test_against_groups(spark, prose, capacity, key_bits, held):
    """Also with buckets that split many times, keys of few bits that collide, and tasks that hold hardly a text."""
    pairs = corpus(prose)
    random.Random(1).shuffle(pairs)
    df = exact.duplicates(make_docs(spark, pairs).withColumnRenamed("row", "entry").repartition(5), capacity=capacity, key_bits=key_bits, held=held)
    check(pairs, df)


def test_empty(spark):
    assert exact.duplicates(make_docs(spark, [])).count() == 0


def test_copies_meet_within_a_task(spark, prose):
    """A text of most rows is one entry a task, not one a row."""
    pairs = [(k, "the same text over and over") for k in range(3000)] + [(k, prose(10, k)) for k in range(3000, 3100)]
    pages, _ = exact.index(make_docs(spark, pairs).repartition(4), Scratch(spark, "test"))
    assert pages.where("n is not null").count() <= 104 and pages.where("n is null").count() == 3100


def cells_of(keys, sizes, bits):
    out = {}
    for k, s in zip(keys, sizes, strict=True):
        size, some = out.get(k >> 64 - bits, (0, set()))
        out[k >> 64 - bits] = (size + s, some | {k})
    return {c: (size, len(some) > 1) for c, (size, some) in out.items()}


def test_directory_splits_and_doubles():
    draw = np.random.default_rng(2)
    keys = [int(x) for x in draw.integers(0, 1 << 63, 500, dtype=np.uint64) * 2]
    depth, owners, n = exact.directory(cells_of(keys, [10] * 500, 12), 12, 100)
    assert len(owners) == 1 << depth and sorted(set(owners.tolist())) == list(range(n)) and (np.diff(owners) >= 0).all()
    loads = np.bincount([owners[k >> 64 - depth] for k in keys], weights=[10] * 500)
    assert loads.max() <= 100 and n < 250  # no owner is overfull, and neighbours share one
    assert exact.directory(cells_of(keys, [1] * 500, 12), 12, 10_000)[0] == 0  # all fits one bucket


def test_directory_leaves_what_it_cannot_split():
    one = [5 << 58] * 50
    assert exact.directory(cells_of(one, [10] * 50, 8), 8, 20)[0] == 0  # copies of one key
    depth, owners, n = exact.directory(cells_of([*one, 1, 1 << 63], [10] * 52, 8), 8, 20)
    assert owners[5 << 58 >> 64 - depth] not in {owners[0], owners[(1 << 63) >> 64 - depth]} and n == 3
    assert exact.directory({}, 4, 10)[0] == 0
