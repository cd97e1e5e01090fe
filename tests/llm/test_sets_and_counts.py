"""Near-dedup, quality rules and scoring against plain Python."""

import collections
import math
import re

import pyarrow as pa
import pytest

from funnelspark.llm import lm_scoring, near_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_groups(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def _groups(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}


def test_near_duplicates_equal_plain_comparison(documents, odd_docs):
    rows = [(r.doc_id + 1000, r.text) for r in documents.collect()]
    docs = documents.withColumn("doc_id", documents.doc_id + 1000).unionByName(odd_docs)
    rows += [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    got = _groups(docs)
    assert got.pop(None) == (6, None)
    assert got == plain_groups(rows)


def test_a_chain_of_near_copies_is_one_group(make_docs):
    words = [f"w{i}" for i in range(400)]
    docs = make_docs(*((i, " ".join(words[5 * i : 5 * i + 200])) for i in range(20)), (99, " ".join(f"x{i}" for i in range(200))))
    got = _groups(docs)
    assert {c for i, (_, c) in got.items() if i < 20} == {0} and got[99][1] == 99


def test_many_near_copies_and_copies(make_docs):
    words = [f"w{i}" for i in range(120)]
    near = [(i, " ".join(words[:40] + [f"z{i}"] + words[40:])) for i in range(60)]
    docs = make_docs(*near, *((100 + i, near[0][1]) for i in range(60)), (500, "a b c d e f"), (501, "A B c d e f"))
    out = near_dedup.near_duplicates(docs).collect()
    assert {r.component_id for r in out if r.doc_id < 200} == {0} and [r.component_id for r in out if r.doc_id == 501] == [500]
    assert sorted(r.doc_id for r in near_dedup.keep_one_of_each_group(docs).collect()) == [0, 500]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_texts_that_share_a_doc_id_keep_their_links(make_docs):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    near = lambda text: text.replace("50", "fifty")
    docs = make_docs((5, a), (5, b), (7, near(a)), (8, near(b)), (9, "alone"))
    assert sorted(tuple(r)[::2] for r in near_dedup.near_duplicates(docs).collect()) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]
    assert len({r.text for r in near_dedup.keep_one_of_each_group(docs).collect()}) == 3


def test_one_of_repeated_rows_stays(make_docs):
    docs = make_docs((1, "some words of a text"), (1, "some words of a text"), (None, "no id"), (None, "no id"), (None, None), (2, None), (2, None), (3, ""), (3, "x"))
    got = sorted(((r.doc_id or 0), r.text or "") for r in near_dedup.keep_one_of_each_group(docs).collect())
    assert got == [(0, ""), (0, "no id"), (1, "some words of a text"), (2, ""), (3, ""), (3, "x")]


def test_pairs_among_documents_of_one_template_are_found(make_docs):
    template = [f"t{i}" for i in range(304)]
    # pairs share 310 of 410 shingles, other documents 300 of 420: their buckets hold the template
    rows = [(i, " ".join([*template, *(f"p{i // 2}x{j}" for j in range(10)), *(f"u{i}x{j}" for j in range(50))])) for i in range(400)]
    assert _groups(make_docs(*rows)) == {i: (360, i - i % 2) for i in range(400)}


def test_sketch_agreement_follows_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 300, dtype=np.uint64)
    one, two = (np.sort(np.concatenate([both, rng.integers(0, 2**63, 100, dtype=np.uint64)])) for _ in range(2))
    row, value = np.repeat([0, 1, 2], [400, 400, 1]), np.concatenate([one, two, both[:1]])
    s = near_dedup.sketches(row, value, 4)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.15 and (s[:3] != 0).all() and (s[3] == 0).all()


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_counts_equal_plain_python(documents, odd_docs):
    texts = [r.text for r in documents.unionByName(odd_docs).collect()]
    got = quality_rules.counts(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [plain_counts(t) for t in texts]


def test_quality_verdicts(documents, odd_docs, make_docs):
    noise = make_docs((10**6, "zq " * 10 + " ".join("".join(chr(0x1F600 + (i * j) % 60) for j in range(6)) for i in range(40))))
    out = {r.doc_id: r for r in quality_rules.quality(documents.unionByName(noise)).collect()}
    assert not out[10**6].kept and not out[10**6].base_failed
    fine = [r for r in out.values() if not r.base_failed]
    assert sum(r.kept for r in fine) > 0.9 * len(fine)
    assert not any(r.kept for r in out.values() if r.base_failed)
    assert quality_rules.quality(odd_docs).count() == 11 and quality_rules.quality(documents.limit(0)).count() == 0


def test_scores_of_odd_texts(odd_docs, documents):
    out = lm_scoring.score(odd_docs).collect()
    assert len(out) == 11
    assert all((r.n_words == 0) == (r.per_word is None) and r.log_score <= 0 for r in out)
    twice = [r for r in out if r.doc_id == 4]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_words == 1
    assert lm_scoring.score(documents.limit(0)).count() == 0


def plain_scores(texts, corpus, alpha=0.4):
    """Sums of logs with c(v w) / c(v) where the bigram was counted, else alpha * c(w) / N."""
    one, two = collections.Counter(), collections.Counter()
    split = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for t in corpus:
        w = split(t)
        one.update(w)
        two.update(zip(w, w[1:]))
    n = sum(one.values()) or 1
    out = []
    for t in texts:
        w = split(t)
        total = math.log(max(one[w[0]], 1) / n) if w else 0.0
        for v, x in zip(w, w[1:]):
            total += math.log(two[v, x] / one[v]) if two[v, x] else math.log(alpha * max(one[x], 1) / n)
        out.append(total)
    return out


def test_scores_equal_plain_counts_with_and_without_a_corpus(documents, make_docs):
    docs = documents.limit(60).unionByName(make_docs((7000, "never Seen never seen words"), (7001, "lone"), (7002, None)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.log_score for r in lm_scoring.score(docs).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(plain_scores([t for _, t in rows], [t for _, t in rows]))
    same = {r.doc_id: r.log_score for r in lm_scoring.score(docs, docs).collect()}
    assert same == pytest.approx(got)
    corpus = documents.filter("doc_id >= 100")
    other = {r.doc_id: r.log_score for r in lm_scoring.score(docs, corpus).collect()}
    assert [other[i] for i, _ in rows] == pytest.approx(plain_scores([t for _, t in rows], [r.text for r in corpus.collect()]))
