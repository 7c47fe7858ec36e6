"""The near-copy stage of the pipeline: five words, similarity 0.8, one row of each component."""

import itertools
import random

import numpy as np
import pytest

from readpool.llm import jaccard
from tests.llm import cases
from tests.llm.test_text_operators import WORD, near_copies, rows


def five_word_components(docs):
    def shingles(text):
        w = WORD.findall((text or "").lower())
        return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t, *_ in docs]
    group = {i: i for i, _ in sets}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            lo, hi = sorted((group[i], group[j]))
            group = {k: lo if g == hi else g for k, g in group.items()}
    return sorted([(i, len(s), group[i]) for i, s in sets], key=repr)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_components_of_five_words(spark, seed):
    docs = near_copies(seed)
    out = jaccard.jaccard_components(cases.frame(spark, docs), words=5, percent=80)
    assert rows(out, "doc_id", "n_shingles", "component_id") == five_word_components(docs)


def test_linked_sets_meet_in_a_list():
    r = random.Random(7)
    for percent, n in itertools.product((80, 90), (1, 4, 9, 17, 40, 150, 600, 2500)):
        for _ in range(12):
            a = r.sample(range(1 << 62), n)
            lost = r.randint(0, n - -(-percent * n // 100))
            more = (100 * (n - lost) - percent * n) // percent
            b = a[lost:] + [r.randrange(1 << 62) for _ in range(r.randint(0, more))]
            x, y = (np.sort(jaccard.mix(np.array(s, np.uint64))) for s in (a, b))
            keys, owner, *_ = jaccard.list_keys([x, y], percent)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_stage_takes_near_copies_below_nine_tenths(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    edited = list(base)
    for k in (30, 80, 130, 180):
        edited[k] = f"edit{k}"
    unlike = base[:140] + [f"v{r.randrange(10**6)}" for _ in range(60)]
    texts = [base, base + [f"footer{i}" for i in range(25)], edited, unlike]
    docs = cases.frame(spark, [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)])
    assert sorted(x["doc_id"] for x in jaccard.one_of_each(spark, docs, "").collect()) == [0, 3]


def test_one_row_of_each_component(spark):
    r = random.Random(9)
    one, two, three = (" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    docs = [(5, one), (5, one), (3, one + " more"), (5, two), (None, two), (None, three), (None, three), (8, None), (8, None), (None, "")]
    out = jaccard.one_of_each(spark, cases.with_clashes(cases.frame(spark, [(i, t, "en", "s", 0) for i, t in docs])), "")
    want = [(3, one + " more"), (5, two), (None, three), (8, None), (8, None), (None, "")]
    assert sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=repr) == sorted(want, key=repr)


def test_unlike_words_do_not_meet(spark):
    """Words of 1,024 letters that polynomial hashes modulo 2**64 cannot tell apart."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = [(i, t, "en", "s", 0) for i, t in ((1, one), (2, other), (3, one + " x y z"), (4, other + " x y z"))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(cases.frame(spark, docs)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_lists_that_sets_leave(spark):
    """A passage in many texts makes lists of many sets, which texts with enough of their own leave; short ones cannot."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    docs = []
    for _ in range(30):
        own = [word() for _ in range(r.choice((6, 12, 60, 200)))]
        for k in range(r.choice((1, 2, 3))):
            at = r.randrange(len(own))
            docs.append(own[:at] + passage + own[at:] + [word() for _ in range(3 * k)])
    docs = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(docs)]
    out = jaccard.jaccard_components(cases.frame(spark, docs), words=5, percent=80)
    assert rows(out, "doc_id", "n_shingles", "component_id") == five_word_components(docs)
