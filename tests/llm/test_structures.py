"""Prefix trees, packing, segmentations, vectors, shingle joins and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cladeframe.llm import chat, common, jaccard, packing, queries, segments, vectors

SF = "/root/testdata/sf0.001"


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- prefix trees ------------------------------------------------------------------


def by_conversation(rows):
    out = defaultdict(list)
    for c, i, r, t in rows:
        out[c].append((i, r or "", t or ""))
    # nulls first, then by turn, role and text
    return {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, v in out.items()}


def test_prefix_tree_query(spark, tables):
    rows = tables("conversations", "conv_id, turn, role, text")
    rows += [(-7, 0, "user", queries.PROBE), (-7, 1, "assistant", queries.PROBE)]
    want = {}
    for c, turns in by_conversation(rows).items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len("".join(chat.formatted(r, t))) for r, t in turns)
        want[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    got = {r[0]: tuple(r[1:]) for r in queries.op1_prefix_tree(spark, SF).collect()}
    assert got == want


ODD_TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "no </s>"), (5, 0, "system", None), (5, 1, None, "x [ROLE]"), (5, 1, None, "x [ROLE]"),
    (6, None, "tool[/ROLE]", "[\\INST] <\\\\/s> <s"), (6, 3, "assistant", ""), (None, 0, "user", "é<|endoftext|>"), (None, 0, "user", "a"),
    (7, 0, "assistant", "</s>[INST] ok [/INST]"), (8, 2, "user", "hi"), (8, 9, "assistant", "yo"), (8, 10, "user", "a" * 70_000),
]


def test_prefix_tree_layout(spark):
    df = spark.createDataFrame([(*r, 1, b"x") for r in ODD_TURNS], "conv_id bigint, turn int, role string, text string, depth int, path binary")
    nodes, convs = chat.format_conversations(df)
    node = {bytes(r.node): r for r in nodes.collect()}
    convs_rows = convs.collect()
    want = by_conversation(ODD_TURNS)
    assert {r.conv_id for r in convs_rows} == set(want)
    distinct = {tuple(v[: i + 1]) for v in want.values() for i in range(len(v))}
    assert len(node) == len(distinct)  # every shared turn once
    coder = chat.Coder(common.tokenizer_path("byte_bpe_50k.json"))
    for r in convs_rows:
        path = [bytes(r.path[i : i + 16]) for i in range(0, len(r.path), 16)]
        ids = [i for p in path for i in node[p].ids]
        assert chat.parse(coder.text(ids)) == want[r.conv_id]
        position = 0
        for d, p in enumerate(path):
            n = node[p]
            assert (n.depth, n.position, n.length, bytes(n.tree)) == (d, position, len(n.ids), path[0])
            seen = [x for s in n.intervals for x in range(s.start, s.end)]
            ancestors = [x for q in path[:d] for x in range(node[q].start, node[q].start + node[q].length)]
            assert sorted(ancestors) == seen
            position += n.length
    for tree in {bytes(n.tree) for n in node.values()}:  # a tree is one gapless stream, every subtree together
        own = sorted((n.start, n.length, n.depth) for n in node.values() if bytes(n.tree) == tree)
        at = 0
        for start, length, _ in own:
            assert start == at
            at += length
    told = {bytes(r.leaf): r for r in chat.read_back(nodes, convs).collect()}
    assert all(told[bytes(r.node)].read_turns == r.n_turns for r in convs_rows)
    empty_nodes, empty_convs = chat.format_conversations(df.limit(0))
    assert empty_nodes.count() == 0 and empty_convs.count() == 0


def test_escapes_are_reversible():
    rng = np.random.default_rng(3)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", "</s>", "[INST]", "a", " "]
    control = re.compile(r"</?s>|\[/?(?:INST|SYS|ROLE)\]")
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 9)))
        assert chat.unescape(chat.escape(text)) == text
        assert not control.search(chat.escape(text))


# ---- packing -----------------------------------------------------------------------


def check_packing(rows, want, window, limit=0.02):
    at = defaultdict(list)
    pieces = defaultdict(list)
    for key, start, length, crc, total, sequence, offset in rows:
        at[sequence].append((offset, length))
        pieces[key].append((start, length, crc, total))
    padding = 0
    for seq in at.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    assert padding <= limit * window * len(at) + window
    assert sorted(at) == list(range(len(at)))
    for key, ids in want.items():
        own = sorted(pieces[key])
        assert sum(x[1] for x in own) == len(ids)
        for start, length, crc, total in own:
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc and total == len(ids)


def test_packing_query(spark, tables):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    docs = tables("documents", "doc_id, text")
    coded = tok.encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    want = {i: [*e.ids, 2] for (i, _), e in zip(docs, coded, strict=True)}
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = [tuple(r) for r in queries.op7_bin_slack(spark, SF).select(*cols).collect()]
    check_packing(rows, want, 4096)


def test_packing_edges(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    texts = {1: None, 2: "", 3: "It's a|b | || <|endoftext|>x <|startoftext|>", 4: "w\x1cé́ \x85 ΣΑΣ İ 12ab " * 300, 1 << 60: "one"}
    rows = [(i, t, 1) for i, t in texts.items()] + [(None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rank int")
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    want[None] = [*tok.encode("no id", add_special_tokens=False).ids, 2]
    got = packing.pack(df, window=64, with_ids=True).collect()
    check_packing([tuple(r)[:5] + (r.sequence_id, r.offset) for r in got], want, 64, limit=1)
    for r in got:
        assert r.ids == want[r.doc_id][r.start : r.start + r.length]
    twice = packing.pack(df.unionAll(df), window=64).groupBy("doc_id").count().collect()
    once = {k: n for k, n in Counter(r.doc_id for r in got).items()}
    assert {r["doc_id"]: r["count"] for r in twice} == {k: 2 * n for k, n in once.items()}
    assert packing.pack(df.limit(0)).count() == 0


def test_best_fill_is_closest():
    rng = np.random.default_rng(7)
    for _ in range(60):
        window = int(rng.choice([12, 16, 21]))
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.choice(np.arange(1, window + 1), rng.integers(1, 5), replace=False)}
        pattern = packing.best_fill(dict(counts), window)
        assert all(n <= counts[x] for x, n in pattern.items()) and max(counts) in pattern
        sums = {0}
        left = {**counts, max(counts): counts[max(counts)] - 1}
        for x, n in left.items():
            sums = {s + j * x for s in sums for j in range(n + 1)}
        sums = {s + max(counts) for s in sums if s + max(counts) <= window}
        slack = lambda s: 0 if s & (s - 1) == 0 else window - s
        assert slack(sum(x * n for x, n in pattern.items())) == min(map(slack, sums))


# ---- segmentations -----------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return segments.Pieces(common.tokenizer_path("piece_bpe_32k.model"))


def all_segmentations(pieces, unit):
    if not unit:
        return [((), 0.0)]
    out = []
    for j in range(1, min(len(unit), pieces.longest) + 1):
        hit = pieces.weight.get(unit[:j])
        if hit:
            out += [((hit[0], *t), hit[1] + w) for t, w in all_segmentations(pieces, unit[j:])]
    if unit[0] not in pieces.weight:
        raw = unit[0].encode()
        out += [((*(int(pieces.byte[b]) for b in raw), *t), pieces.byte_weight * len(raw) + w) for t, w in all_segmentations(pieces, unit[1:])]
    return out


def test_samples_have_the_right_chances(pieces):
    text, n, k = "the ab\nx", 20_000, 3
    full = [((), 0.0)]
    for unit in pieces.units(text):
        full = [(a + b, x + y) for a, x in full for b, y in all_segmentations(pieces, unit)]
    total = np.log(sum(np.exp(w) for _, w in full))
    chance = {t: np.exp(w - total) for t, w in full}
    lat = segments.Lattices(pieces)
    batch = segments.Batch(lat, lat.codes([text] * n), np.arange(n, dtype=np.uint64) * np.uint64(7919), k)
    drawn = defaultdict(list)
    for docs, value, edges, first, count, mass in batch.run():
        for i, d in enumerate(docs):
            ids = tuple(int(x) for x in lat.ids(edges[first[i] : first[i] + count[i]])[0])
            assert np.exp(mass[i]) == pytest.approx(chance[ids])
            drawn[d].append((ids, value[i]))
    first_counts, pairs = Counter(), Counter()
    for v in drawn.values():
        assert len({x for x, _ in v}) == k and all(v[i][1] >= v[i + 1][1] for i in range(k - 1))
        first_counts[v[0][0]] += 1
        pairs[v[0][0], v[1][0]] += 1
    for a, p in chance.items():
        assert abs(first_counts[a] / n - p) < 5 * np.sqrt(p / n) + 1e-3
        for b, q in chance.items():
            if a != b:
                want = p * q / (1 - p)
                assert abs(pairs[a, b] / n - want) < 5 * np.sqrt(want / n) + 1e-3


def test_lattices_turn_and_keep_what_is_met_again(pieces):
    texts = ["the cat sat\n\n  on the ▁ mat", None, "", " ", "\n a", "é 梦 the \x00", *(f"the cat {i} ab{i * 7919}x" for i in range(40))]
    cut = segments.Lattices(pieces)
    for t, codes in zip(texts, cut.codes(texts), strict=True):
        units, names = pieces.units(t), list(cut)
        assert [names[c].decode().replace(" ", "▁") for c in codes] == units
    seeds = np.arange(1, 4, dtype=np.uint64)
    small, kept = segments.Lattices(pieces, most_edges=400), 0
    for a in range(0, len(texts), 3):
        part, got = texts[a : a + 3], []
        size = len(small)
        for lat in (small, segments.Lattices(pieces)):
            codes = lat.codes(part)
            kept += lat is small and size > len(small) > len(set(np.concatenate(codes).tolist()))
            ids = [(d.tolist(), f.tolist(), c.tolist(), lat.ids(e)[0].tolist()) for d, _, e, f, c, _ in segments.Batch(lat, codes, seeds[: len(part)], 2).run()]
            got.append(ids)
            told = lat.ids(segments.Batch(lat, codes, seeds[: len(part)], 1).run()[0][2])[0]
            assert pieces.decode_all(told, np.array([0]), np.array([len(told)])) == [pieces.decode(told.tolist())]
        assert got[0] == got[1]
    assert kept > 0


def test_segmentations_round_trip(spark, tables):
    docs = tables("documents", "doc_id, text")
    rows = [(i, t, 3) for i, t in docs] + [(-1, None, 1), (-2, "", 1), (-3, "  two  spaces\n\n é 梦 \t\x00", 1), (None, "x" * 3000, 1), (-4, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sample int")
    made = segments.decode_pieces(segments.sample_segmentations(df, k=2)).collect()
    texts = {i: t or "" for i, t, _ in rows}
    seen = defaultdict(list)
    for r in made:
        assert r.decoded == texts[r.doc_id]
        assert r.n_pieces == len(r.ids) and r.log_prob <= 1e-9 and r.log_inclusion <= 1e-12
        seen[r.doc_id].append(tuple(r.ids))
    assert set(seen) == set(texts) and all(len(set(v)) == len(v) for v in seen.values())
    assert len(seen[-1]) == len(seen[-2]) == 1 and sum(len(v) == 2 for v in seen.values()) >= len(docs)
    again = segments.sample_segmentations(df.repartition(5), k=2, with_ids=False).collect()
    assert {(r.doc_id, r.sample, r.ids_crc32) for r in again} == {(r.doc_id, r.sample, r.ids_crc32) for r in made}
    assert segments.sample_segmentations(df.limit(0)).count() == 0


# ---- vectors -----------------------------------------------------------------------


def linked_by_hand(rows, cosine=0.95):
    good = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[n] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine]
    return links


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.3])]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 16), (302, [1.0, None] + [0.0] * 14), (303, [float("nan")] * 16), (304, []), (305, [float("inf")] + [1.0] * 15)]
    rows += [(306, [float(x) for x in base[0][:7]]), (307, [float(x) for x in 3 * base[0][:7]])]
    df = spark.createDataFrame([(i, v, 0, "n") for i, v in rows], "vec_id bigint, embedding array<float>, members int, node string")
    links = linked_by_hand(rows)
    least = least_reachable(range(len(rows)), links)
    n = Counter(x for pair in links for x in pair)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, list_size=20, certainty=4.0).collect()}
    want = {i: (n[k], rows[least[k]][0], rows[least[k]][0] == i) for k, (i, _) in enumerate(rows)}
    right = sum(min(got[i][0], want[i][0]) for i in want) / sum(w[0] for w in want.values())
    assert right >= 0.99 and all(got[i][0] <= want[i][0] for i in want)
    assert vectors.near_vectors(df.limit(0)).count() == 0
    exact = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, list_size=20, certainty=1e9).collect()}
    assert exact == want


def test_vector_recall_on_the_table(spark, tables):
    rows = tables("embeddings", "vec_id, embedding")
    links = linked_by_hand(rows)
    n = Counter(rows[x][0] for pair in links for x in pair)
    got = {r.vec_id: r.n_links for r in queries.op3_product_codes(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows} and all(got[i] <= n[i] for i in got)
    assert sum(got.values()) >= 0.9 * sum(n.values())


# ---- shingle joins -----------------------------------------------------------------


def shingles(text, size=5):
    words = [w.lower() for w in (text or "").encode().split()]
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def near_copies(rng, n):
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words, rng.integers(3, 60))) for _ in range(n // 8)]
    out = []
    for _ in range(n):
        w = base[rng.integers(len(base))].split()
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(len(w))] = str(rng.choice(words))
        out.append(" ".join(w))
    return out


def test_jaccard_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = near_copies(rng, 400) + ["", None, "  \n", "One two", "one  TWO", "É x", "é x", "w1 " * 4000]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[5])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, c int, slice int")
    sets = [shingles(t) for _, t in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    place = least_reachable(range(len(rows)), links)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[place[i]].append(rows[i][0])
    want = sorted(
        [(rows[i][0], len(sets[i]), min([x for x in groups[place[i]] if x is not None], default=None)) for i in range(len(rows))], key=str
    )
    got = sorted([tuple(r) for r in jaccard.jaccard_components(df).collect()], key=str)
    assert got == want
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(i, i + 1) for i in range(100, 160)] + [(300, 301 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in common.components(df).collect()}
    want = least_reachable({x for e in edges for x in e}, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}


# ---- pipeline ----------------------------------------------------------------------


def test_pipeline(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "secret_scan", "packing"]
    texts = dict(tables("documents", "doc_id, text"))
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert kept[-1].columns == docs.columns
    ids = [{r[0]: r[1] for r in k.select("doc_id", "text").collect()} for k in kept[:5]]
    assert all(a >= b for a, b in zip(map(len, ids), map(len, ids[1:]), strict=False)) and len(ids[1]) > 0.95 * len(texts)
    assert all(ids[1][i] == texts[i] for i in ids[1])
    sets = {i: shingles(t) for i, t in ids[2].items()}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert set(ids[3]) == set(least_reachable(sets, links).values())
    for i, text in ids[4].items():
        spans = corpus_pipeline.secrets.find_secrets(ids[3][i])
        assert (text == ids[3][i]) == (not spans) and (not spans or corpus_pipeline.MASK in text)
    want = {i: None for i in ids[4]}
    assert {r.doc_id for r in kept[5].select("doc_id").distinct().collect()} == set(want)
    assert corpus_pipeline.run(spark, SF).count() == kept[5].count()


def test_a_filter_on_the_language_does_not_predict_twice(spark):
    made = corpus_pipeline.language_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_packing_slices_hold_a_bounded_part_of_a_batch():
    import pyarrow as pa

    from cladeframe.llm import words

    rows = [(str(i), None if i % 5 == 0 else "é" * (i % 9)) for i in range(300)] + [(None, "x" * 500)]
    batch = pa.RecordBatch.from_pydict({"k": [k for k, _ in rows], "t": pa.array([t for _, t in rows], pa.string())})
    parts = list(words.slices(batch, 40))
    assert [(k, t) for keys, texts in parts for k, t in zip(keys, texts, strict=True)] == rows
    assert [len(k) for k, _ in parts] == [b - a for a, b in words.blocks([t for _, t in rows], 40)]
    assert list(words.slices(batch.slice(0, 0), 40)) == []


def test_pipeline_edges(spark):
    rows = [
        (None, "the house and the dog and the cat", "en", "s", None), (None, "the house and the dog and the cat", "en", "s", None),
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5),
        (4, "a cat in the house token=abcdefgh1", None, "s", 1), (5, "das Haus und der Hund und die Katze", "de", "s", 1), (5, "das Haus und der Hund und die Katze", "de", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    got = {(r.doc_id, r.text) for r in docs.collect()}
    assert docs.count() == len(got) == 3
    assert (4, "a cat in the house [SECRET]") in got
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_segments_query_returns_and_decodes_the_samples(spark, tables):
    texts = dict(tables("documents", "doc_id, text"))
    rows = queries.op9_gumbel_segments(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_double_vectors(spark):
    """Huge, tiny and nearly equal doubles are compared as they are."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 8))
    rows = [b * s for b in base for s in (1.0, 1e200, 1e-200, 3e-310 / np.abs(b).max())]
    rows += [b + rng.normal(size=8) * 0.1 for b in base for _ in (1, 2)] + [base[0] * (1 + 2.0**-52), np.array([1e308] * 8)]
    rows.append(np.array([1e200, 1e199, 0, 0, 0, 0, 0, 0]))
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    got = {r[0]: tuple(r)[1:3] for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id int, embedding array<double>")).collect()}
    x = np.array([v / np.abs(v).max() for v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T
    assert (np.abs(near - 0.95) > 1e-6).all()  # subnormal components keep some digits only
    links = [(a, b) for a in range(len(rows)) for b in range(a) if near[a, b] >= 0.95]
    roots = least_reachable(range(len(rows)), links)
    count = Counter(i for pair in links for i in pair)
    assert got == {i: (count[i], roots[i]) for i in range(len(rows))}


def test_jaccard_holds_a_bounded_number_of_texts(spark):
    import pyarrow as pa

    from cladeframe.llm import jaccard

    batch = pa.RecordBatch.from_pydict({"t": [None if i % 7 == 0 else f"text {i}" for i in range(1300)]})
    parts = [t for _, t in jaccard.sliced(iter([batch]))]
    assert max(map(len, parts)) <= jaccard._ROWS and sum(parts, []) == batch.column("t").to_pylist()
    # one batch of more texts than are held at once
    rows = [(i, None if i % 9 == 0 else f"one two three four five six seven {i % 600}") for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {i: (0, i) if t is None else (4, first[t]) for i, t in rows}
