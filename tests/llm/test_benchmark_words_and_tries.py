"""Decontamination, spelling variants and the prefix trie against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from funnelspark.llm import decontamination, prefix_trie, spelling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_hits(text, items):
    """Words hit, and the items that occur."""
    w = WORD.findall(low(text))
    covered, named = set(), set()
    for item, body in items:
        x = WORD.findall(low(body))
        m = min(len(x), 10)
        windows = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if x else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in windows:
                covered.update(range(i, i + m))
                named.add("" if item is None else str(item))
    return len(w), len(covered), sorted(named)


def hits(docs, benchmark):
    rows = decontamination.contaminated_words(docs, benchmark).collect()
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_hit, r["items"]) for r in rows)


def test_contamination_equals_plain_search(spark, make_docs, documents, odd_docs):
    long_ = " ".join(f"q{i}" for i in range(25))
    items = [(1, long_), (2, "q3 q4 Q5 q6 q7 q8 q9 q10 q11 q12"), (10, "short one"), (3, "solo"), (4, None), (5, ""), (6, " - !"), (None, "no id here at all"), (7, "a a a a a a a a a a"), (1, "second text of item one"), (2, "q3 q4 Q5 q6 q7 q8 q9 q10 q11 q12")]
    items += [(100 + r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(20).collect()]
    own = [
        (5000, "x " + long_ + " y"), (5001, " ".join(long_.split()[:9])), (5002, "q3, q4; q5 q6 q7 q8 q9 q10 q11 q12!"), (5003, "a short one, SOLO; short ones"), (5004, "a " * 25 + "b " + "a " * 9),
        (5005, "no id here at all"), (5005, "no id here at all"), (None, "solo"), (5006, None), (5007, "second text of item one q1 q2"), (5008, long_ + " " + long_)]
    docs = documents.unionByName(odd_docs).unionByName(make_docs(*own))
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, n_words int")
    want = sorted(((-1 if r.doc_id is None else r.doc_id), *plain_hits(r.text, items)) for r in docs.collect())
    assert hits(docs.withColumnsRenamed({"source": "n_hit"}), benchmark) == want
    assert sum(w[2] > 0 for w in want) >= 8


def test_contamination_of_empty_tables(spark, documents, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontamination.contaminated_words(documents, none).collect())
    some = spark.createDataFrame([(1, "one two")], none.schema)
    assert decontamination.contaminated_words(documents.limit(0), some).count() == 0
    assert hits(make_docs((1, "one")), some) == [(1, 1, 0, [])]


def plain_variants(rows):
    count = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            count[w] += len(w) >= 5
    n = {w: c for w, c in count.items() if c >= 3}
    near, same = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            same[i, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for group in same.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def test_variants_equal_plain_search(documents, odd_docs, make_docs):
    base = ["orange", "window", "ÀÉîøÿ", "aaaaaaaa", "mississippi", "z" * 500]
    made = [(9000 + i, f"{w} " * 40 + f"{w[:2]}{w[3:]} " * 9 + f"{w[:2]}q{w[3:]} " * 9 + f"x{w} {w}x " * 4 + f"{w[:2]}{w[4:]} " * 3) for i, w in enumerate(base)]
    docs = documents.unionByName(odd_docs).unionByName(make_docs(*made, (None, "orange window " * 5), (9100, "A×B ÷ Àbcdé " * 4)))
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(docs.withColumnRenamed("source", "word")).collect())
    assert got == plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(g[1] != "" for g in got) > 100 and any(g[1] and g[1] != g[2] for g in got)
    assert spelling.variants(documents.limit(0)).count() == 0


def test_a_chain_of_forms_ends_at_its_root(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("v", "w20")], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w21"}


def test_pivots_are_disjoint_and_cheapest():
    place, cost = np.array([[0, 1, 2], [0, 1, 5], [3, 4, 6]]), np.array([[5, 1, 5], [9, 1, 2], [1, 3, 7]])
    assert spelling.pivots(place, cost).tolist() == [0b101, 0b110, 0b101]


def test_checksums_equal_zlib():
    words = [b"", b"1:a", b"123456789", "12:héros".encode()]
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    heads = np.array([0, zlib.crc32(b"x"), 0, 7], dtype=np.uint32)
    assert spelling._crc32(heads, data, np.cumsum(size) - size, size).tolist() == [zlib.crc32(w, int(h)) for w, h in zip(words, heads)]


def plain_trie(rows):
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text) rows, by their whole sequence."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())
            turns[c].append((key, (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def made_conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t if c % 3 else c} é") for c in range(40) for t in range(2 + c * 7 % 23)]
    rows += [(50, None, None, None), (50, None, "user", ""), (50, 1, "user", "a"), (50, 1, "user", "b"), (50, 1, "user", "a"), (None, 0, "user", "nobody")]
    rows += [(100 + i, t, "user", f"same {t}") for i in range(30) for t in range(3)]
    return rows + [(7, 3, "user", "a second turn 3"), (-7, 0, "user", "a"), (-7, 1, "user", "b" * 100_000), (200, 0, None, "x" * 50), (203, 0, "", "x" * 50)]


@pytest.mark.parametrize("band", (2, 3, 16))
def test_trie_equals_plain_python(spark, band):
    rows = made_conversations()
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, d string")
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame, band).collect()), key=lambda r: (r[1], r[0]))
    assert got == plain_trie(rows)


def test_long_and_empty_tries(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", "t" if t < 70 else f"{c % 2}") for c in range(0, 15, 5) for t in range(90)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, kind), 4).collect()), key=lambda r: (r[1], r[0]))
    assert got == plain_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
