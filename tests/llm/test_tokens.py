"""Token memory, id files, importance resampling and zone maps against plain computations."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cladeframe.llm import idfiles, queries, resample, words, zonemaps
from cladeframe.llm.common import read, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  a", "a  ", "a <|endoftext|> b", "<|endoftext|>x  <|startoftext|>", "| a|b |", "\n\n", "a \n b  c\t\td ",
    "!\x1cb a\x1c b", "don't 's  's\n's", "<| endoftext|> <|x", "日本語 テキスト　です", "a\r\nb\r\n", " \U0001f600 \U0001f600x",
    "   y 　 z", "x" * 300 + " y\n" + "z" * 700 + " ", " a" * 200 + "\n" * 5, "# ## #", "\x00 \x00a",
]


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_give_the_ids_of_whole_texts(spark, name, byte_level):
    texts = ODD + [r["text"] for r in read(spark, SF, "documents").select("text").collect()]
    plain = Tokenizer.from_file(tokenizer_path(name))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    coder = words.WordMemory(tokenizer_path(name), byte_level, most_bytes=20_000)  # turns often
    for _ in (1, 2):
        got = [i.tolist() for a in range(0, len(texts), 7) for i in coder.encode(texts[a : a + 7])]
        assert got == want


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "_PLACES", [np.zeros(256, np.uint64), words._PLACES[1]])  # every part has the same key
    coder = words.WordMemory(tokenizer_path("word_bpe_49k.json"), False)
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = ["one two three two", "three four one"]
    for _ in (1, 2):
        assert [i.tolist() for i in coder.encode(texts)] == [plain.encode(t).ids for t in texts]


@pytest.mark.parametrize("most", [1, 2, 17, 50257, 200_000, 1 << 31])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 70_000])
def test_coder_round_trip(n, most):
    ids = np.random.default_rng(n + most).integers(0, most, n).astype(np.uint32)
    assert (idfiles.decode_block_ids(idfiles.encode_block_ids(ids)) == ids).all()


def test_coder_learns_and_notices_damage():
    ids = np.tile(np.arange(50, dtype=np.uint32), 3000)
    coded = idfiles.encode_block_ids(ids)
    assert len(coded) * 8 < 3 * len(ids)  # 5.6 bits an id without contexts
    assert (idfiles.decode_block_ids(coded) == ids).all()
    broken = bytearray(coded)
    broken[len(coded) // 2] ^= 64
    with pytest.raises(ValueError, match="damaged"):
        idfiles.decode_block_ids(bytes(broken))
    with pytest.raises(ValueError, match="not a segment"):
        idfiles.decode_block_ids(b"x" * 64)


def test_coder_of_many_different_ids():
    ids = np.random.default_rng(3).permutation(600_000).astype(np.uint32) * np.uint32(7000)  # rests of up to 15 bits
    assert (idfiles.decode_block_ids(idfiles.encode_block_ids(ids)) == ids).all()


def test_class_and_sixteenth_are_coded_in_one_step():
    rng = np.random.default_rng(5)
    lanes, steps = np.arange(40), rng.choice(256, (1024, 40), p=rng.dirichlet(np.full(256, 0.1))).astype(np.uint8)
    told, read = idfiles._Counts(40), idfiles._Counts(40)
    plain = np.full((40, 256), 4)
    width = np.full(40, (1 << 40) + 12_345, np.uint64)
    for symbols in steps:
        below, share = told.encode(lanes, symbols, width)
        unit = width // plain.sum(1).astype(np.uint64)
        assert (below == unit * np.array([plain[i, :x].sum() for i, x in enumerate(symbols)], np.uint64)).all()
        assert (share == unit * plain[lanes, symbols].astype(np.uint64)).all()
        found, code, again = read.decode(lanes, below + share - np.uint64(1), width)
        assert (found == symbols).all() and (again == share).all() and (code == share - np.uint64(1)).all()
        plain[lanes, symbols] += 24


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_words_of_twenty_bits(n):
    given = np.random.default_rng(n).integers(0, 1 << 20, n).astype(np.uint32)
    made = idfiles._bytes(given)
    assert len(made) == 5 * (n + n % 2) // 2
    assert (idfiles._words(b"head" + made, 4)[:n] == given).all()


def test_hashes_take_eight_bytes_at_a_time():
    parts = [b"a", b"a\0", b"\0a", b"\0", b"\0\0", b"eightbyt", b"eightbyt\0", b"eightbytes", b"x" * 16, b"x" * 17, b"x" * 255]
    raw = b"".join([*parts, b"|", *parts])
    size = np.array([len(p) for p in parts])
    first = np.cumsum(size) - size
    here, there = (np.stack(words._hashes(raw, first + a, size)) for a in (0, len(raw) // 2 + 1))
    assert (here == there).all()  # wherever a part stands
    assert len({*here.ravel().tolist()}) == 2 * len(parts)


def _token_rows(rows):
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op12_gives_the_ids_of_every_document(spark):
    got = sorted(tuple(r) for r in queries.op12_id_blocks(spark, SF).collect())
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    assert got == _token_rows(rows)


def test_id_files_of_odd_rows(spark, tmp_path):
    rows = [(f"k{i:02d}", t) for i, t in enumerate(ODD)] + [(None, "x"), ("k03", "  a"), ("zz", "long text " * 300_000)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id string, text string, at int, file int")
    folder = str(tmp_path / "ids")
    idfiles.write_ids(df, folder, segment_ids=100)
    got = idfiles.read_ids(spark, folder, "string", with_ids=True).orderBy("start").collect()
    want = _token_rows(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] or "")))
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert idfiles.encode_table(df.limit(0)).collect() == []


def _draw(docs, target, buckets=10_000, least=20, percent=5):
    def features(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]
        return len(found), [zlib.crc32(g.encode()) % buckets for g in grams]

    found = [(k, *features(t)) for k, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in found:
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = {}
    for k, n, f in found:
        h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out[k] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    fit = sorted((-v[3], k) for k, v in out.items() if v[0] >= least)
    ranks = {k: i for i, (_, k) in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted((k, v[1], v[2], v[3], ranks.get(k)) for k, v in out.items())


def test_op11_draws_like_the_plain_form(spark):
    got = sorted(tuple(r) for r in queries.op11_importance_draw(spark, SF).collect())
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in read(spark, SF, "benchmark").select("text").collect()]
    assert got == _draw(docs, target)
    assert sum(r[4] is not None for r in got) > 0


def test_resample_odd_rows(spark):
    texts = [None, "", "!!", "Ab cd, ÀB-cd x{y}z", "a" * 70 + " " + "b" * 200 + " c", "É é 日本 語", "one two " * 9, "w " * 100_000]
    docs = list(enumerate(texts))
    target = ["one two three", None, "cd x"]
    df = spark.createDataFrame([(k, t, 0, 1.0) for k, t in docs], "doc_id int, text string, k int, score double")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.importance_resample(df, aim, least_words=2, percent=50)
    assert sorted(tuple(r) for r in got.collect()) == _draw(docs, target, least=2, percent=50)
    none = resample.importance_resample(df.limit(0), aim.limit(0))
    assert none.collect() == []
    again = spark.createDataFrame([(None, "x y"), (None, "x y"), ("a", "x y")], "doc_id string, text string")
    ranks = [r["rank"] for r in resample.importance_resample(again, aim, least_words=1, percent=100).collect()]
    assert sorted(ranks) == [1, 2, 3]


def test_hilbert_curve_is_one_walk():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = zonemaps.hilbert_keys(cells, 3)
    walk = cells[sorted(range(len(cells)), key=lambda i: keys[i].tobytes())]
    assert len({k.tobytes() for k in keys}) == len(cells)
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_candidates_hold_the_nearest():
    rng = np.random.default_rng(5)
    for _ in range(50):
        rows = rng.integers(-20, 20, (30, 4)) + rng.integers(-50, 50, 4)
        centers = rng.integers(-60, 60, (8, 4))
        every = ((rows[:, None] - centers) ** 2).sum(2)
        among = zonemaps.candidates(rows.min(0), rows.max(0), centers)
        best, far = zonemaps.nearest(rows, centers, among)
        assert (best == every.argmin(1)).all() and (far == every.min(1)).all()


def _kmeans(rows, many=8, rounds=10, dim=64):
    kept = [(k, [math.floor(1024 * x) for x in v]) for k, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:many]
    centers, x = np.array([v for _, v in start], object), np.array([v for _, v in kept], object)
    for again in range(rounds + 1):
        far = ((x[:, None] - centers) ** 2).sum(2)
        best = [min(range(len(centers)), key=lambda c, i=i: (far[i, c], c)) for i in range(len(x))]
        if again < rounds:
            for c in set(best):
                mine = [i for i, b in enumerate(best) if b == c]
                centers[c] = [t // len(mine) for t in x[mine].sum(0)]
    inertia = [sum(far[i, c] for i, b in enumerate(best) if b == c) for c in range(len(centers))]
    return sorted(
        (k, c, far[i, c], inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest())
        for i, ((k, _), c) in enumerate(zip(kept, best, strict=True))
    )


def test_op13_clusters_like_the_plain_form(spark):
    got = sorted(tuple(r) for r in queries.op13_hilbert_zones(spark, SF).collect())
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, SF, "embeddings").collect()]
    assert got == _kmeans(rows)


def test_cluster_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = [(i, [float(x) for x in rng.normal(size=4) * 10]) for i in range(40)] + [(100 + i, [1.0, -2.0, 0.5, 0.0]) for i in range(200)]
    bad = [(300, None), (301, []), (302, [1.0]), (303, [1.0, None, 0.0, 0.0]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0])]
    rows = good + bad + [(5, good[5][1]), (400, [100_000.0, -100_000.0, 0.0, 0.001])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id int, embedding array<double>, place string, n int")
    got = zonemaps.cluster_vectors(df, dim=4, block_rows=16)
    assert sorted(tuple(r) for r in got.collect()) == _kmeans(rows, dim=4)
    few = df.filter("vec_id < 3")
    assert sorted(tuple(r) for r in zonemaps.cluster_vectors(few, dim=4).collect()) == _kmeans(rows[:3], dim=4)
    assert zonemaps.cluster_vectors(df.filter("vec_id > 900"), dim=4).collect() == []
    named = spark.createDataFrame([(None, [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", [3.0, 1e300])], "vec_id string, embedding array<double>")
    assert sorted(str(r["vec_id"]) for r in zonemaps.cluster_vectors(named, dim=2).collect()) == ["None", "a"]
