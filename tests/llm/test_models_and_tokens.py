"""Language identification, packing, sampling, search and archives: brute force, round trips and held-out accuracy."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from funnelspark.llm import ann, language_id, packing, piece_sampling, warc
from funnelspark.llm.byte_bpe import ByteBpe
from tests.llm.conftest import MIDDLE, SMALL

ODD = ["", None, " ", "  a  b ", "x\n\n y", "a <|endoftext|> b", "日本 語", "I'm  it's\t'll d\n", "é ñ  ó123 4\r\n5", "a\u0085 b", "\x1c a \x1f b", "a  b  c"]


def test_held_out_accuracy_and_scores(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    assert len(held) > 250 and sum(r.lang_pred == r.lang for r in held) > 0.98 * len(held)


def test_code_lengths_are_those_of_single_bytes(documents):
    model = language_id.build(language_id.train(documents))
    size = int(model.symbol.max()) + 1
    texts = ["", "a", "ab", "", "é", "hello wörld\n", "日本"]

    def plain(text):
        data = b"\n" * language_id.ORDER + text.encode()
        bits = np.zeros(len(model.languages))
        for i in range(language_id.ORDER, len(data)):
            place = 0
            for back in range(language_id.ORDER, 0, -1):
                place = place * size + model.symbol[data[i - back]]
            bits += model.bits[model.rows[place] * size + model.symbol[data[i]]]
        return bits

    assert np.allclose(language_id.code_lengths(pa.array(texts), model), [plain(t) for t in texts])
    chance = np.exp2(-model.bits.astype(float)).reshape(-1, size, len(model.languages))
    chance[:, -1] *= 256 - (size - 1)
    assert np.allclose(chance.sum(axis=1), 1)


def test_language_of_odd_texts(odd_docs, documents):
    out = {r.doc_id: r for r in language_id.identify(documents.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd_docs)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and out[5].lang_pred == out[6].lang_pred != "und"
    assert {r.lang_pred for r in language_id.identify(odd_docs.filter("lang IS NULL")).collect()} == {"und"}
    assert language_id.identify(documents.limit(0)).count() == 0
    assert language_id.keep_identified(odd_docs).columns == odd_docs.columns


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_those_of_the_tokenizer(documents, tokenizer):
    bpe = ByteBpe.of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab 1 .'\n\té  s<|Ω") for _ in range(rng.randint(0, 40))) for _ in range(1000)] + [r.text for r in documents.collect()]
    got = bpe.encode(pa.array(texts), 1)
    assert all(list(a) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t, a in zip(texts, got))


def test_pieces_put_together_are_the_documents(documents, odd_docs, tokenizer):
    docs = documents.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd_docs.filter("doc_id != 4"))
    pieces = packing.pack(docs).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs.filter("doc_id < 1050").collect():
        own = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist()
        assert ids == [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] and {p.doc_tokens for p in own} == {len(ids)}
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) <= 2048
    assert packing.pack(documents.limit(0)).count() == 0


def test_windows_rise_when_capacity_is_exceeded():
    assert sorted(map(len, packing.windows_of([1500, 1500, 1500]))) == [1, 1, 1]
    sizes = [random.Random(i).randint(200, 512) for i in range(2000)]
    found = packing.windows_of(sizes)
    assert sorted(i for w in found for i in w) == list(range(2000))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) <= 2048 and sum(sizes) > 0.96 * 2048 * len(found)
    assert packing.windows_of([]) == [] and packing.windows_of([5]) == [[0]]


def _all_segmentations(lattices, text):
    start, _ = lattices.starts([text])
    out = {}

    def walk(word, state, path, log):
        if state == -1:
            if word + 1 == len(start):
                out[tuple(path)] = log
                return
            word, state = word + 1, start[word + 1]
        for e in range(lattices.first[state], lattices.first[state + 1]):
            walk(word, lattices.next[e], [*path, e], log + lattices.log[e])

    walk(0, start[0], [], 0.0)
    return out


def test_samples_are_distinct_and_follow_the_lattice():
    lattices = piece_sampling.Lattices.of(public_tokenizers.path("piece_bpe_32k.model"))
    every = _all_segmentations(lattices, "ab c")
    assert abs(sum(map(math.exp, every.values())) - 1) < 1e-9
    n, mass, first, second = 20_000, 0.0, collections.Counter(), collections.Counter()
    for paths, limit in piece_sampling.sample(lattices, ["ab c"] * n, np.arange(n, dtype=np.uint64) * 7919 + 3, 2):
        one, two = (tuple(e.tolist()) for e, _, _ in paths)
        assert one != two and paths[0][2] >= paths[1][2] >= limit and abs(every[one] - paths[0][1]) < 1e-9
        first[one] += 1
        second[one, two] += 1
        mass += sum(math.exp(log) / -math.expm1(-math.exp(log - limit)) for _, log, _ in paths)
    assert abs(mass / n - 1) < 0.01
    assert all(abs(first[s] / n - math.exp(p)) < 0.01 for s, p in every.items())
    assert all(abs(second[a, b] / n - math.exp(every[a] + every[b]) / (1 - math.exp(every[a]))) < 0.01 for a in every for b in every if a != b)


def test_sampled_ids_decode_to_the_text(documents, odd_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents.limit(40).unionByName(odd_docs)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    out = piece_sampling.decode(piece_sampling.encode(docs, 3)).collect()
    plain = lambda t: (t or "").replace("▁", " ")
    assert {(r.doc_id, r.text) for r in out} == {(i, plain(t)) for i, t in texts}
    assert all(model.decode(r.ids) == r.text for r in out if r.doc_id is not None and r.doc_id < 5 and r.ids)
    assert max(r["sample"] for r in out) == 3 and all(-1e9 < r.log_inclusion <= 0 for r in out)
    again = piece_sampling.encode(docs.repartition(5), 3).collect()
    assert {(r.doc_id, r["sample"], tuple(r.ids)) for r in out} == {(r.doc_id, r["sample"], tuple(r.ids)) for r in again}


def _plain_nearest(rows, query, k=20):
    own = dict(rows)[query]
    near = sorted((-math.fsum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != query)
    return [i for _, i in near[:k]]


def test_recall_of_nearest_neighbours(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    many = table.unionByName(table.select((F.col("vec_id") + 10_000).alias("vec_id"), F.transform("embedding", lambda x: (x * 0.9 + 0.01).cast("float")).alias("embedding"), "label"))
    for i in range(2, 6):
        many = many.unionByName(table.select((F.col("vec_id") + 10_000 * i).alias("vec_id"), F.reverse("embedding").alias("embedding"), "label") if i % 2 else table.select((F.col("vec_id") + 10_000 * i).alias("vec_id"), "embedding", "label"))
    rows = [(r.vec_id, r.embedding) for r in many.collect()]
    out = collections.defaultdict(list)
    for r in ann.search(many, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r)
    queries = [i for i, _ in rows if i % 20 == 0]
    assert set(out) == set(queries) and all([r["rank"] for r in out[q]] == list(range(1, 21)) for q in queries)
    some = queries[:40]
    assert sum(len({r.vec_id for r in out[q]} & set(_plain_nearest(rows, q))) for q in some) >= 0.9 * 20 * len(some)


def test_parts_share_blocks_and_a_block_hands_on_the_nearest_alone(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    assert ann.blocks_of({0: 60, 1: 40, 2: 1, 3: 250, 4: 99, 5: 1, 6: 1}) == {0: (0, 0), 1: (0, 0), 2: (1, 1), 3: (2, 4), 4: (5, 5), 5: (5, 5), 6: (6, 6)}
    found = [(7, 3, 1.0), (7, 1, 1.0), (7, 2, 2.0), (7, 3, 1.0), (7, 9, 0.5), (5, 1, 0.1), (7, 4, -1.0)]
    best = ann.best_of(*(np.array(c) for c in zip(*found)), 3)
    assert list(zip(*(c.tolist() for c in best))) == [(5, 1, 0.1), (7, 2, 2.0), (7, 1, 1.0), (7, 3, 1.0)]
    assert [len(c) for c in ann.best_of(*(np.zeros(0),) * 3, 3)] == [0, 0, 0]


def test_a_block_gives_the_same_as_parts_alone(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2400, 8)))] + [(3000 + i, [1.0] * 8) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "ROWS_PER_PART", 300)
    lists = []
    for block in (4096, 700, 100):
        monkeypatch.setattr(ann, "BLOCK", block)
        lists.append([tuple(r) for r in ann.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()])
    assert len(lists[0]) == 130 * 20 and lists[0] == lists[1] == lists[2]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert ann.search(table.filter("vec_id = 3"), F.lit(True)).count() == 0


@pytest.mark.parametrize("version", (1, 2))
def test_pages_survive_both_archives(spark, tmp_path, version):
    long_ = "ü" * 600
    pages = [(1, "http://a b/", "<p>x</p>\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, " ", long_), (4, "u", long_), (5, "u", ""), (6, "v", "short"), (7, "v", "short"), (None, "w", "no id")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    arc, out = f"{tmp_path}/arc", f"{tmp_path}/warc"
    warc.write_arc(table, arc, version)
    records = warc.mark_revisits(warc.convert_arc(spark, arc))
    warc.write_warc(records, out)
    back = warc.read_warc(spark, out)
    found = {r.page_id: r for r in back.collect()}
    assert {i: found[i].payload for i, _, h in pages if i != 3} == {i: h or "" for i, _, h in pages if i != 3}
    assert found[3].record_type == "revisit" and found[3].payload is None and found[3].refers_to_id == found[4].record_id
    assert {r.date for r in found.values()} == {"2024-01-01T00:00:00Z"} and found[2].url == "unknown:"
    resolved = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolve(back).collect()}
    assert resolved[3] == (1200, "revisit", 4) and resolved[4] == (1200, "response", None) and resolved[7] == (5, "response", None)


def test_arc_headers_of_both_versions_and_damage():
    two = b"filedesc://x 0.0.0.0 20240101 text/plain 200 - - 0 x 10\n2 0 origin\nhttp://a 1.2.3.4 20240101120000 text/html 200 - - 0 x 5\nhello\n"
    records = list(warc.arc_records(two))
    assert [h["url"] for h, _ in records][1:] == ["http://a"] and records[1][1] == b"hello"
    spaced = b"http://a b 1.2.3.4 20240101120000 text/html 3\nxyz\nbroken line\n"
    assert list(warc.arc_records(spaced)) == [({"url": "http://a b", "ip": "1.2.3.4", "date": "20240101120000", "mime": "text/html", "length": "3"}, b"xyz")]
    assert warc.iso_date("202401011200") == "2024-01-01T12:00:00Z" and warc.iso_date("bad") == "1970-01-01T00:00:00Z"


def test_archive_of_no_pages(spark):
    assert warc.archive(spark.read.parquet(f"{SMALL}/pages.parquet").limit(0)).count() == 0


def test_lattices_built_at_once_equal_those_built_word_by_word():
    words = ["▁the", "▁window", "▁a😀b", "▁ünïcödé", "▁日本語", "\x00\x01", "▁▁▁", "▁" + "long" * 40, "▁" + "😀" * 40, "é"]
    lattices = piece_sampling.Lattices.of(public_tokenizers.path("piece_bpe_32k.model"))

    def paths(build):
        lattices._reset()
        build(words)
        out = {}
        for word in words:
            state, steps = lattices.known[word], []
            while state >= 0:
                a, b = lattices.first[state : state + 2]
                steps.append((lattices.log[a:b].round(9).tolist(), lattices.upto[a:b].round(9).tolist(), lattices.ids(np.arange(a, b)).tolist()))
                state = lattices.next[b - 1]  # the longest piece
            out[word] = steps
        lattices._reset()
        return out

    assert paths(lattices.learn) == paths(lattices._learn_long)


def _lattices():
    return piece_sampling.Lattices.of(public_tokenizers.path("piece_bpe_32k.model"))


def _sampled(texts, k):
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(7919) + np.uint64(5)
    lattices = _lattices()
    return [([(x.tolist(), log, value) for x, (_, log, value) in zip(lattices.ids_of_paths([e for e, _, _ in paths]), paths)], limit) for paths, limit in piece_sampling.sample(lattices, texts, keys, k)]


def test_sampling_hashes_a_few_numbers_for_each_edge(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(4000))
    hashed = []
    plain = piece_sampling.mix
    monkeypatch.setattr(piece_sampling, "mix", lambda x: hashed.append(np.size(x)) or plain(x))
    ((paths, _),) = piece_sampling.sample(_lattices(), [text], np.array([11], np.uint64), 2)
    edges = sum(len(e) for e, _, _ in paths)
    assert len(paths) == 2 and edges > 20_000 and sum(hashed) < 4 * edges


def test_forks_out_of_reach_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "ab c", " ".join("".join(rng.choices("etaoinshrdlué", k=rng.randint(1, 9))) for _ in range(600))] * 30
    expected = _sampled(texts, 3)
    assert all(len(paths) == 3 for (paths, _), t in zip(expected, texts) if len(t) > 1)
    for reach in (0.0, 38.0, np.inf):
        monkeypatch.setattr(piece_sampling, "REACH", reach)
        assert _sampled(texts, 3) == expected


def test_words_of_texts_begin_at_runs_of_spaces():
    texts = [t or "" for t in ODD] + ["▁", "a▁b", " ▁a", "a ", "  ", "日本 語▁ x\n y"]
    words, counts = piece_sampling._words(pa.array(texts))
    expected = [re.findall("▁*[^▁]+|▁+", "▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    assert [w.replace(" ", "▁") for w in words.to_pylist()] == [w for ws in expected for w in ws]
    assert counts.tolist() == list(map(len, expected))


def test_steps_between_pieces_are_those_of_the_vocabulary():
    lattices = _lattices()
    node = {prefix: i + 1 for i, prefix in enumerate(lattices.pieces)}
    rng = random.Random(6)
    some = [x for x in node if len(x) > 1][::7] + [rng.choice(list(node)) + rng.choice("aeqz▁日") for _ in range(3000)]
    got = lattices._onward(np.array([node.get(x[:-1], 0) for x in some], np.int32), lattices.class_of[[ord(x[-1]) for x in some]])
    assert got.tolist() == [node.get(x, 0) for x in some]


def test_ids_from_either_end_are_decoded():
    lattices = _lattices()
    size = len(lattices.spelled)
    none, low, high = piece_sampling.decode_bytes(lattices, [np.zeros(0, np.int32), np.array([5000, -1], np.int32), np.array([5000, size - 1], np.int32)])
    assert none == b"" and low == high and low
    with pytest.raises(IndexError):
        piece_sampling.decode_bytes(lattices, [np.array([size], np.int32)])
