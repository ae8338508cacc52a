"""Near-duplicates whose similarity is exactly the threshold."""

import numpy as np

from apiscope.llm import common, near_dups

from .helpers import documents, shingles

#: Unions of 5k shingles of which 4k are shared; adding 4k fractions 1 / 5k gives less than 0.8.
SHORT = [k for k in range(1, 400) if np.sum(np.full(4 * k, 1 / (5 * k))) < 0.8][:24]


def text(k, first, runs):
    """So many runs of five distinct words."""
    return " ".join(f"w{k}x{i}" for i in range(first, first + runs + 4))


def test_pairs_at_the_threshold(spark):
    assert len(SHORT) == 24
    rows, want = [], {}
    for n, k in enumerate(SHORT):
        whole, at, below = 10 * n, 10 * n + 1, 10 * n + 5
        rows += [(whole, text(k, 0, 5 * k), "en"), (at, text(k, 0, 4 * k), "en"),
                 # a bucket of three, whose least member links the others
                 (at + 1, text(k, k, 4 * k), "en"),
                 (below, text(-k, 0, 5 * k), "en"), (below + 1, text(-k, 0, 4 * k - 1), "en")]
        want |= {whole: whole, at: whole, at + 1: whole, below: below, below + 1: below + 1}
    got = {r.doc_id: r.class_id for r in near_dups.classes(documents(spark, rows)).collect()}
    assert got == want


def test_links_of_a_block_at_the_threshold():
    for k in SHORT:
        texts = [text(k, 0, 5 * k), text(k, 0, 4 * k), text(k, 0, 4 * k - 1)]
        far = np.array([True, True])
        assert near_dups._links_of(np.array([1, 2]), far, far, texts[:2]) == [(1, 2)]
        assert near_dups._links_of(np.array([1, 3]), far, far, texts[::2]) == []


def test_near_copies_meet_one_text_each(spark, monkeypatch):
    """A group of near copies is not compared with the least member of each of its buckets."""
    counted, real = [], near_dups._estimates

    def estimates(pairs, sigs):
        counted.append(pairs.count())
        return real(pairs, sigs)

    monkeypatch.setattr(near_dups, "_estimates", estimates)
    shared = " ".join(f"s{i}" for i in range(200))
    rows = [(i, f"{shared} " + " ".join(f"p{i}x{k}" for k in range(12)), "en") for i in range(40)]
    found = near_dups.classes(documents(spark, rows)).collect()
    assert {r.class_id for r in found} == {0} and len(found) == 40
    assert sum(counted) < 80


def test_links_of_a_group_follow_its_members(spark, monkeypatch):
    """Blocks of a large group of near copies, some of them not alike, return few links."""
    counted, real = [], near_dups.components

    def components(links):
        counted.append(links.distinct().count())
        return real(links)

    monkeypatch.setattr(near_dups, "components", components)
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rng = np.random.default_rng(6)
    texts = []
    for i in range(160):
        words = [f"w{k}" for k in range(300)]
        for k in rng.choice(300, rng.integers(2, 6), replace=False):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    found = {r.doc_id: r.class_id for r in near_dups.classes(documents(spark, rows)).collect()}
    # no shingle stands twice in a text
    sets = [set(shingles(t)) for t in texts]
    assert all(len(x) == 296 for x in sets)
    want = list(range(len(texts)))
    for i, x in enumerate(sets):
        for k in range(i):
            if 10 * len(x & sets[k]) >= 8 * len(x | sets[k]) and want[i] != want[k]:
                low, high = sorted((want[i], want[k]))
                want = [low if w == high else w for w in want]
    assert found == dict(enumerate(want))
    assert max(counted) < 3 * len(texts)


def test_links_of_a_block_are_between_classes():
    """Classes known before need no link, and those found are a star around the largest."""
    texts = [text(1, 0, 50), text(1, 0, 49), text(1, 0, 48), text(1, 0, 47), text(2, 0, 50)]
    label, far = np.array([7, 7, 3, 3, 5]), np.array([False, False, True, True, True])
    assert near_dups._links_of(label, far, far, texts) == [(3, 7)]
    assert near_dups._links_of(label[[0, 1, 4]], far[[0, 1, 4]], far[[0, 1, 4]], [
        texts[k] for k in (0, 1, 4)]) == []


def test_a_worker_keeps_the_words_of_one_operator():
    common.kept("words", dict)
    assert list(common.tidy(iter, keeps=True)([1])) == [1] and "words" in common._kept
    assert list(common.tidy(iter)([2])) == [2] and not common._kept
