"""Every operator of the subpackage against a brute-force version, with odd rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import zstandard

from sluiceway.llm import chunking, common, jaccard, leaks, lines, pages, pieces, quality, suffixes, tokens, vectors

WORDS = "mill barn sluice weir pond gate wheel race stone flour grain sack cart mule road ford".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = np.random.default_rng(3)
    shared = _text(rng, 60)
    rows = []
    for i in range(120):
        body = "\n".join(_text(rng, int(rng.integers(4, 40))) for _ in range(6))
        if i % 4 == 1:
            body = rows[-1][1]
        elif i % 4 == 2:
            body = rows[-2][1] + " changed"
        elif i % 4 == 3:
            body += "\n" + shared
        rows.append((i, body))
    rows += [(200, None), (201, ""), (202, "word"), (203, "word"), (204, "  \n "), (205, _text(rng, 30_000)), (7, rows[7][1])]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "'x' AS v", "1 AS n", "2 AS i", "'y' AS t"
    )
    return df.repartition(3), frame


@pytest.fixture
def small_chunks(monkeypatch):
    pack = common.pack_docs
    few = lambda docs, i, t, size=0: pack(docs, i, t, 4000)
    monkeypatch.setattr(jaccard, "pack_docs", few)
    monkeypatch.setattr(suffixes, "pack_docs", few)
    monkeypatch.setattr(chunking, "pack_docs", few)


def _shingle_sets(frame):
    sets = {}
    for i, t in zip(frame.doc_id, frame.text):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return sets


def _components(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_jaccard_groups(corpus, small_chunks):
    df, frame = corpus
    sets = _shingle_sets(frame)
    ids = sorted(sets)
    linked = [
        (a, b) for a in ids for b in ids
        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0
    ]
    low = _components(ids, linked)
    got = jaccard.jaccard_groups(df).toPandas()
    assert len(got) == len(frame)
    assert all(low[i] == c and len(sets[i]) == n for i, n, c in got.itertuples(index=False))
    assert {r.doc_id for r in jaccard.one_of_each(df).collect()} == {i for i in ids if low[i] == i}


def test_jaccard_without_leaders_is_the_same(corpus, small_chunks):
    """The last step alone finds every link, too."""
    df, _ = corpus
    want = jaccard.jaccard_groups(df).toPandas().sort_values("doc_id")
    got = jaccard.jaccard_groups(df, jaccard.JaccardParams(rounds=1, leaders=0)).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == want.component_id.tolist()


@pytest.mark.parametrize("block, block_tokens", [(512, 1 << 18), (40, 1 << 18), (512, 3000)])
def test_jaccard_of_a_crowd(spark, small_chunks, monkeypatch, block, block_tokens):
    """Copies of one text with words changed, most too far apart: all links, and no pair of rows for each two."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(160, int(rng.integers(2, 6)), False):
            words[at] = f"x{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, rows[i][1]) for i in range(20)]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    sets = _shingle_sets(frame)
    linked = [
        (a, b) for a in sets for b in sets
        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    low = _components(sorted(sets), linked)
    asked, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    params = jaccard.JaccardParams(block=block, block_tokens=block_tokens)
    got = jaccard.jaccard_groups(df, params).toPandas()
    assert 50 < len(set(low.values())) < 350
    assert [low[i] for i in got.doc_id] == got.component_id.tolist()
    assert sum(asked) < 10 * len(rows)


def test_overlaps_of_two_blocks():
    rng = np.random.default_rng(13)
    sides = [[np.sort(rng.choice(300, int(rng.integers(1, 90)), False)).astype(np.uint64) for _ in range(n)] for n in (7, 9)]
    flat = [(np.concatenate(s), np.array([len(x) for x in s])) for s in sides]
    got = jaccard._overlaps(*flat[0], *flat[1], columns=64)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]


def test_encoder_learns_plain_words_once():
    """Words of letters, and those with a stop behind, need no pieces of their own; ids are the vocabulary's."""
    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["mill barn, weir! don't x2 (pond) été. . ,, a.b.", "weir? barn gate\ttab  two <|endoftext|> gate.", "", " ", "mill"]
    got = coder.encode(texts) + coder.encode(texts[::-1])
    own = [e.ids for e in coder.tokenizer.encode_batch([t.replace("<|", "< |") for t in texts], add_special_tokens=False)]
    keep = [i for i, t in enumerate(texts) if "<|" not in t]
    assert all(np.frombuffer(got[i], "<u2").tolist() == own[i] for i in keep)
    assert got[: len(texts)] == got[len(texts) :][::-1]
    plain = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert plain.encode(["a mill barn, weir!"]) == coder.encode(["a mill barn, weir!"])
    assert not {" mill", " barn", " weir"} & plain.pieces.keys() and {"mill", "barn", "weir"} <= plain.words.keys()


def test_repeated_bytes(corpus, small_chunks):
    df, frame = corpus
    got = suffixes.repeated_bytes(df, with_text=True).toPandas().set_index("doc_id")
    texts = {i: (t or "").encode() for i, t in zip(frame.doc_id, frame.text)}
    seen = set()
    for i in sorted(texts):
        b = texts[i]
        own = [b[j : j + 50] for j in range(len(b) - 49)]
        cover = bytearray(len(b))
        for j, w in enumerate(own):
            if w in seen:
                cover[j : j + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, m in zip(b, cover) if not m)
        rows = got.loc[[i]]
        assert set(rows.n_removed) == {sum(cover)} and set(rows.n_bytes) == {len(b)}
        assert set(rows.kept_sha256) == {hashlib.sha256(kept).hexdigest()}
        assert set(rows.n_spans) == {len(bytes(cover).replace(b"\0", b" ").split())}
    assert len(got) == len(frame)


def test_chunk_dedup(corpus, small_chunks):
    df, frame = corpus
    got = chunking.chunk_dedup(df, with_text=True).toPandas()
    params, first = chunking.ChunkParams(), {}
    texts = sorted((i, (t or "").encode()) for i, t in set(zip(frame.doc_id, frame.text)))
    for i, b in texts:
        ends = chunking.cut_places(b, params)
        spans = list(zip([0, *ends], ends))
        again = "".join("01"[first.setdefault(b[a:z], (i, n)) != (i, n)] for n, (a, z) in enumerate(spans))
        kept = b""
        for m in re.finditer("0+|1+", again):
            part = b[spans[m.start()][0] : spans[m.end() - 1][1]]
            if m[0][0] == "0" or len(part) < params.run and m[0] != again:
                kept += part
        rows = got[got.doc_id == i]
        assert {bytes(k) for k in rows.kept} == {kept} and set(rows.n_chunks) == {len(ends)}
    assert len(got) == len(frame) and got.n_removed.sum() > 100


def test_cuts_return_after_an_insertion():
    text = _text(np.random.default_rng(1), 2000).encode()
    params = chunking.ChunkParams()

    def parts(b):
        ends = chunking.cut_places(b, params)
        return {b[a:z] for a, z in zip([0, *ends], ends)}

    assert len(parts(text) & parts(text[:500] + b"inserted" + text[500:])) > 0.95 * len(parts(text))


def test_merge_runs():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            s = sorted(bytes(rng.integers(97, 99, rng.integers(1, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 30)))
            common_ = [0] + [len(_prefix(a, b)) for a, b in zip(s, s[1:])]
            runs.append((s, common_[: len(s)]))
        order, lcps = suffixes.merge_runs(runs)
        out = [runs[r][0][i] for r, i in order]
        assert out == sorted(x for r in runs for x in r[0])
        assert lcps[1:] == [len(_prefix(a, b)) for a, b in zip(out, out[1:])]


def _prefix(a, b):
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def _line_model(rows):
    first, gone = {}, {}
    windows = []
    for i, t in rows:
        own = [x for x in (t or "").split("\n") if x.strip(" ")]
        windows += [(3, tuple(own[j : j + 3]), (i, j)) for j in range(len(own) - 2)]
        windows += [
            (n, tuple(own[j : j + n]), (i, j))
            for n in (1, 2)
            for j in range(len(own) - n + 1)
            if sum(len(x.encode().split()) for x in own[j : j + n]) >= 50
        ]
    for n, body, at in sorted(windows, key=lambda w: w[2]):
        if first.setdefault((n, body), at) != at:
            gone.setdefault(at[0], set()).update(range(at[1], at[1] + n))
    return gone


def test_line_dedup(corpus):
    df, frame = corpus
    gone = _line_model(list(frame.drop_duplicates().itertuples(index=False)))
    got = lines.line_dedup(df).toPandas()
    assert len(got) == len(frame) and list(got.columns[:6]) == list(df.columns)
    for r in got.itertuples():
        before = frame.text[frame.doc_id == r.doc_id].iloc[0]
        own = gone.get(r.doc_id, set())
        assert r.line_dedup_removed == len(own)
        if own:
            full = [x for x in before.split("\n") if x.strip(" ")]
            assert r.text == "\n".join(x for j, x in enumerate(full) if j not in own)
        else:
            assert r.text == before or before is None and r.text is None


def test_line_runs_by_words(spark):
    """Two lines of 50 words together are a run; blanks before a brace are no words."""
    two = " ".join(f"a{i}" for i in range(30)) + "\n" + " ".join(f"b{i}" for i in range(20))
    short = " ".join(f"c{i}" for i in range(30)) + "\n" + " ".join(f"d{i}" for i in range(19))
    brace = " " * 52 + "}"
    rows = [
        (1, f"one\n{two}\nend 1\n{short}\nlast 1\n{brace}"),
        (2, f"two\n{two}\nend 2\n{short}\nlast 2\n{brace}"),
        (3, two),
        (None, "\t" * 60 + "x"),
        (4, "\t" * 60 + "x"),
    ]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.line_dedup_removed for r in got} == {1: 0, 2: 2, 3: 2, None: 0, 4: 0}
    assert {r.doc_id: r.text for r in got}[2] == f"two\nend 2\n{short}\nlast 2\n{brace}"


def test_chunks_of_phrases_stay_and_short_copies_go(spark):
    rng = np.random.default_rng(3)
    a, b = _text(rng, 200), _text(rng, 200)
    shared = _text(rng, 60)
    rows = [(1, a), (2, b), (3, "tiny"), (4, "tiny"), (5, a), (6, a[:300] + shared), (7, b[:150] + shared + "\u00e9")]
    df = spark.createDataFrame([*rows, (8, None), (9, "")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in chunking.chunk_dedup(df, with_text=True).collect()}
    assert [bytes(got[i].kept) for i in (1, 2, 3)] == [a.encode(), b.encode(), b"tiny"]
    assert [bytes(got[i].kept) for i in (4, 5, 8, 9)] == [b""] * 4
    assert got[6].n_removed and got[7].n_removed
    assert chunking.long_runs({0, 1, 3}, [40, 80, 120, 250, 260], 96) == {3}
    assert chunking.long_runs({0, 1}, [40, 80], 96) == {0, 1}
    assert chunking.long_runs(set(), [], 96) == set()


def test_merging_in_ranges_changes_nothing(corpus, monkeypatch):
    df, _ = corpus
    blobs = [r.blob for r in common.pack_docs(df, "doc_id", "text", 2000).collect()]
    chunks = [suffixes._Chunk(b) for b in blobs]
    runs = [
        data
        for number, c in enumerate(chunks)
        for _, data in suffixes._runs_of(c, number, np.ones(len(c.hash), bool), 1)
    ]
    heads = [np.zeros(20, np.uint64), np.arange(9, dtype=np.uint64)]

    def reduced():
        return [(r, *(sorted(zip(*(x.tolist() for x in rest))),)) for r, *rest in sorted(suffixes._reduce(runs), key=lambda x: x[0])]

    want = reduced()
    assert len(want) > 3 and len(suffixes._ranges(heads)[0]) == 2
    monkeypatch.setattr(suffixes, "AT_ONCE", 7)
    assert len(suffixes._ranges(heads)[0]) > 3 and reduced() == want


def test_suffixes_fall_evenly_into_buckets(corpus):
    """Anchors are the lowest of 31 hashes; the lowest range of them must not be one bucket's."""
    df, _ = corpus
    counts = np.zeros(32, int)
    for r in common.pack_docs(df, "doc_id", "text", 1 << 20).collect():
        chunk = suffixes._Chunk(r.blob)
        for b, data in suffixes._runs_of(chunk, 0, np.ones(len(chunk.hash), bool), 32):
            counts[b] += struct.unpack_from("<qI", zstandard.decompress(data))[1]
    assert counts.sum() > 5000 and counts.max() < 3 * counts.mean()


def test_suffix_buckets_grow_with_the_text(corpus, monkeypatch):
    df, _ = corpus
    chunks = common.pack_docs(df, "doc_id", "text", 20_000)
    few = suffixes._buckets(chunks)
    monkeypatch.setattr(suffixes, "BUCKET", 1000)
    assert few == common.partitions(df.sparkSession)
    assert suffixes._buckets(chunks) >= chunks.selectExpr("sum(length(blob))").first()[0] / 1000 > few


def test_suffixes_of_a_blob_in_pieces(corpus, monkeypatch):
    df, _ = corpus
    blobs = [r.blob for r in common.pack_docs(df, "doc_id", "text", 40_000).collect()]

    def cut():
        runs = {}
        for number, blob in enumerate(blobs):
            pieces = list(suffixes._pieces(blob))
            for b, data in suffixes._runs_of(pieces, number, np.ones(sum(len(p.at) for p in pieces), bool), 3):
                runs.setdefault(b, []).append(data)
        found = [[] for _ in blobs]
        for each in runs.values():
            for number, *rest in suffixes._reduce(each):
                found[number].append(zstandard.compress(b"".join(x.tobytes() for x in rest)))
        rows = [suffixes._cut(b, pd.DataFrame({"data": f}), True) for b, f in zip(blobs, found)]
        return rows, max(len(list(suffixes._pieces(b))) for b in blobs)

    want, pieces = cut()
    assert pieces == 1 and sum(r[2] for rows in want for r in rows) > 10_000
    monkeypatch.setattr(suffixes, "CHUNK", 5000)
    got, pieces = cut()
    assert pieces > 5 and got == want


def test_quality_held_out(spark):
    rng = np.random.default_rng(5)
    rows = [
        (i, _text(rng, 40) if i % 3 else " ".join(w.upper() + "!!" for w in rng.choice(WORDS, 40)), int(i % 3 > 0))
        for i in range(600)
    ]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "x y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).toPandas()
    assert len(got) == 603 and got.score.between(0, 1).all()
    named = got[got.doc_id.notna()]
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 3 == 1) for i, h in zip(named.doc_id, named.held_out))
    held = named[named.held_out & (named.doc_id < 600)]
    assert (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.98
    none = quality.score_documents(docs, quality.train(docs, labels.limit(0))).toPandas()
    assert set(none.score) == {0.5}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([c + rng.standard_normal((int(rng.integers(1, 40)), 16)) * 0.12 for c in centres])
    x = np.concatenate([x, x[:30], 3 * x[30:40]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] + [0.0] * 15), (9005, [None] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    got = vectors.near_vectors(df, vectors.VectorParams(block=128)).toPandas().set_index("vec_id")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = got.loc[range(len(x)), "n_links"].to_numpy()
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
    low = _components(range(len(x)), list(zip(*np.nonzero(near))))
    assert np.mean([low[i] == got.component_id[i] for i in range(len(x))]) > 0.99
    assert (got.loc[9000:, "n_links"] == 0).all() and got.loc[9000:, "kept"].all()


@pytest.mark.parametrize("audit, few", [(4096, 8), (500, 8), (500, 0)])
def test_vectors_of_one_crowded_topic(spark, audit, few):
    """Pairs among vectors of mutual cosine 0.8, far more than passes and window reach."""
    rng = np.random.default_rng(4)
    topic, n = rng.standard_normal(64), 1500
    x = 2 * topic / np.linalg.norm(topic) + rng.standard_normal((n, 64)) / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:300] = x[300:600] + rng.standard_normal((300, 64)) * 0.2 / 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    params = vectors.VectorParams(passes=2, window=2, block=64, audit=audit, rounds=3, few=few)
    got = vectors.near_vectors(df, params).toPandas().set_index("vec_id").sort_index()
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert 300 <= near.sum() / 2 < 400
    assert got.n_links.tolist() == near.sum(1).tolist()
    low = _components(range(n), list(zip(*np.nonzero(near))))
    assert got.component_id.tolist() == [low[i] for i in range(n)]


@pytest.mark.parametrize("few", [0, 1, 1000])
def test_vectors_lose_no_link_whatever_the_size(spark, few):
    """A few pairs in a crowd, which a sample of the vectors does not show."""
    rng = np.random.default_rng(8)
    topic, n = rng.standard_normal(64), 3000
    x = 2 * topic / np.linalg.norm(topic) + rng.standard_normal((n, 64)) / 8
    x[:30] = x[30:60] + rng.standard_normal((30, 64)) * 0.2 / 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    params = vectors.VectorParams(passes=2, window=2, block=64, audit=100, rounds=1, few=few)
    got = vectors.near_vectors(df, params).toPandas().set_index("vec_id").sort_index()
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() >= 40
    assert got.n_links.tolist() == near.sum(1).tolist()
    low = _components(range(n), list(zip(*np.nonzero(near))))
    assert got.component_id.tolist() == [low[i] for i in range(n)]


def test_vectors_odds_of_a_missed_link():
    """What the passes say they miss is what they miss."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    same, places = vectors._same_side(0.95), 1 << np.arange(61, -1, -1, dtype=np.int64)
    told, true = [], []
    for p in range(8):
        planes = vectors._planes(vectors.VectorParams(), p, 32)
        key, other = (((z @ planes) >= 0) @ places for z in (x, y))
        order = np.argsort(key)
        block = order[1000:1400]
        told += list(1 - np.exp(-vectors._odds(x[block], key[block], planes, (True, True), same)))
        true += list((other[block] >= key[block[0]]) & (other[block] <= key[block[-1]]))
    told, true = np.array(told), np.array(true)
    assert told.mean() > 0.3 and true.mean() >= told.mean() - 0.03
    sure = told > 0.7
    assert sure.any() and true[sure].mean() >= told[sure].mean() - 0.05


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<nav>a</nav><article><h1>T</h1><p>one<br>two &lt;3<p>three</article><footer>f</footer>", "T one two <3 three"),
        ("<script>x='</p>'</script><div class='ad'>buy</div><main><p> a  b </p></main>", "a b"),
        ("<article><p>a</p><div class='comments'>c</div><aside>s</aside><form>f</form><p>b", "a b"),
        ("<article>cut <b", "cut"),
    ],
)
def test_main_text(html, text):
    assert pages.main_text(html) == text


@pytest.mark.parametrize(
    "inside, text",
    [
        ('<p>see <a href="/hidden-gems">the best places</a></p>', "see the best places"),
        ('<p title="the hidden truth">one</p>', "one"),
        ('<p title="a > b" data-class="ad" data-hidden>one</p>', "one"),
        ('<div class="overflow-hidden">one</div>', "one"),
        ('<p aria-hidden="false">one</p>', "one"),
        ('<h2 id="reply-to-critics">one</h2>', "one"),
        ('<h2 id="the-search-for-water" class="section-header">one</h2>', "one"),
        ('<section id="share-of-water"><p>one</p></section>', "one"),
        ('<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>', "if x=2 then"),
        ('<div class="no-sidebar">one</div>', "one"),
        ('<p hidden>n</p>', ""),
        ("<p HIDDEN=''>n</p>", ""),
        ('<p hidden="until-found">one</p>', "one"),
        ('<p style="color:red; display : none">n</p>', ""),
        ('<p style="visibility:hidden">n</p>', ""),
        ('<div class="widget share-buttons">n</div>', ""),
        ('<div class="inner post-comments">n</div>', ""),
        ('<section id="comments">n</section>', ""),
        ('<div role="navigation">n</div>', ""),
        ('<div class="js-cookie">n</div>', ""),
    ],
)
def test_main_text_by_whole_attributes(inside, text):
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4))
    words = "".join(f"{'word ' * 30}{i} " for i in range(4))
    assert pages.main_text(f"<article>{body}{inside}</article>") == f"{words}{text}".strip()


def test_main_text_without_marks():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4))
    page = f"<body><div>Home</div><div>About</div><div></div>{body}</body>"
    assert pages.main_text(page).endswith("3") and pages.main_text(page).count("word") == 120


def test_main_text_beside_a_marked_teaser():
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4))
    teaser = "<article><h2>More</h2><p>read this one as well</p></article>"
    for page in (teaser + f"<div>{body}</div>", f"<div>{body}</div>" + teaser, body[:300] + "</p>" + teaser + body):
        assert pages.main_text(page).count("word") >= 120
    article = f"<article><h1>T</h1>{body}</article>"
    text = pages.main_text("<div>Home</div>" + article + f"<div>{'Terms of use. ' * 20}</div>")
    assert text.startswith("T word") and text.endswith("word 3")


@pytest.mark.parametrize(
    "start, end",
    [("<div class='page has-sidebar'>", "</div>"), ("<div id=wrapper class='no-sidebar'>", "</div>"), ("<form id=login>", "</form>")],
)
def test_main_text_in_an_element_named_as_noise(start, end):
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4))
    side = "<div class=sidebar>side</div><p class=ad>buy</p>"
    for page in (f"<article>{body}</article>", f"<div>{body}</div>"):
        text = pages.main_text(f"<nav>n</nav>{start}{side}{page}{side}{end}<footer>f</footer>")
        assert text.count("word") == 120 and "side" not in text and "buy" not in text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p class=notice>n<p>one<p>two</article>", "one two"),
        ("<article><p class=ad>n<div>one</div><p>two</article>", "one two"),
        ("<div><p class=ad>n</div><article>one</article>", "one"),
        ("<article><ul><li class=menu>n<ul><li>m</ul><li>one<li>two</ul>three</article>", "one two three"),
        ("<article><table><tr><td class=ad>n<td>one<tr class=ad><td>m<tr><td>two</table>three</article>", "one two three"),
        ("<article><dl><dt class=ad>n<dd>one<dd class=ad>m<dt>two</dl>three</article>", "one two three"),
        ("<article><datalist><option class=ad>n<option>one</datalist>two</article>", "one two"),
        ("<article>one <span class=ad>n <span>m</span> o</span> two</article>", "one two"),
        ("<head><meta name=x><body><article>one</article>", "one"),
    ],
)
def test_main_text_after_noise_without_an_end_tag(html, text):
    assert pages.main_text(html) == text


def test_id_files_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 255, 256, 257, 65_536, 70_001):
        ids = rng.zipf(1.3, n) % 50_000
        lengths = np.array([n])
        docs, got_lengths, got = tokens.decode_file(tokens.encode_file(np.array([9]), lengths, ids))
        assert (got == ids).all() and docs.tolist() == [9] and got_lengths.tolist() == [n]
    data = bytearray(tokens.encode_file(np.array([9]), np.array([300]), rng.integers(0, 9, 300)))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        tokens.decode_file(bytes(data))


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    df, frame = corpus
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = common.new_folder(spark, "ids")
    tokens.write_ids(df, folder, path)
    got = tokens.read_ids(spark, folder).toPandas().sort_values("start")
    plain = Tokenizer.from_file(path)
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t in zip(frame.doc_id, frame.text))):
        ids = plain.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got.itertuples(index=False)] == want


@pytest.mark.parametrize("text", ["", " ", "  a  b\n c", "tab\t b \t", " lead", "trail ", "日本 語 \U0001f600", "a\n b", "it's 12 34a"])
def test_encoders_on_odd_spaces(text):
    coder = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(coder.encode([text])[0], "<u2").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    model = pieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    ids = np.frombuffer(model.encode([text])[0], "<i4")
    assert pieces.decode_ids(ids, model.auto, pieces.spelling(model.auto)) == text


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(6)
    texts = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 4))) for _ in range(14)} - {"b"})
    scores = [float(-x) for x in rng.permutation(len(texts))]
    byte_ids = list(range(1000, 1256))
    auto = pieces.build_automaton(list(zip(texts, scores)), byte_ids, frozenset())
    for _ in range(200):
        word = "".join(rng.choice(list("abé"), rng.integers(1, 9)))
        best = {0: 0.0}
        for end in range(1, len(word) + 1):
            options = [best[s] + scores[texts.index(word[s:end])] for s in range(end) if word[s:end] in texts]
            best[end] = max([*options, best[end - 1] + auto.unknown])
        ids = np.frombuffer(pieces.segment([word.encode()], auto)[0], "<u4").tolist()
        assert b"".join(bytes([i - 1000]) if i >= 1000 else texts[i].encode() for i in ids) == word.encode()
        known = sum(scores[i] for i in ids if i < 1000)
        spelled = bytes(i - 1000 for i in ids if i >= 1000)
        assert known + auto.unknown * len(spelled.decode()) == pytest.approx(best[len(word)])


def test_ids_are_those_of_the_models_own_encoder():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = pieces.encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["text"]).text]
    rng = np.random.default_rng(9)
    letters = list("  aeinrstth\n\t éß漢字①\U0001f600.,012")
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)]
    texts += [" " * k + "x" + " " * k for k in range(70)] + ["the " * 30_000]
    for a in range(0, len(texts), 256):
        part = texts[a : a + 256]
        ids = [np.frombuffer(x, "<i4").tolist() for x in model.encode(part)]
        assert ids == own.encode(part, num_threads=1)
    # the merges step by step, which a word takes that no path reaches
    for text in ("the", "retition", "a①b", "x\U0001f600漢"):
        word = pieces._MARK + text.encode()
        assert np.frombuffer(pieces._merged(word, model.auto), "<u4").tolist() == own.encode(text)


def test_leaks(spark):
    rng = np.random.default_rng(8)
    items = [(i, _text(rng, 12).capitalize() + " " + _text(rng, 8).capitalize()) for i in range(30)]
    docs = [(i, _text(rng, 200)) for i in range(40)]
    docs += [(100 + i, _text(rng, 150) + " " + t.upper() + " " + _text(rng, 90)) for i, t in items]
    table = spark.createDataFrame(docs + [(500, None), (501, ""), (None, items[3][1])], "doc_id bigint, text string")
    bench = spark.createDataFrame(items + [(77, None), (78, "..."), (None, "a b c")], "item_id bigint, text string")
    want = {(100 + i, i) for i, _ in items}
    for params in (leaks.LeakParams(), leaks.LeakParams(index_bytes=900)):
        got = leaks.find_leaks(table, bench, params).toPandas()
        pairs = {(int(a), int(b)) for a, b in zip(got.doc_id.fillna(-1), got.item_id)}
        assert want | {(-1, 3)} <= pairs
        clean = {r.doc_id for r in leaks.drop_leaks(table, bench, params).collect()}
        assert clean >= {500, 501} and not clean & {a for a, _ in want}
    assert leaks.find_leaks(table, bench.limit(0)).count() == 0


def test_leaks_of_every_text_of_an_id(spark):
    rng = np.random.default_rng(12)
    texts = [_text(rng, 12).capitalize() + " " + _text(rng, 8).capitalize() for _ in range(12)]
    items = [(i // 3, t) for i, t in enumerate(texts)]
    docs = [(i, _text(rng, 150) + " " + t + " " + _text(rng, 90)) for i, t in enumerate(texts)]
    docs.append((50, texts[0] + " " + texts[1]))
    table = spark.createDataFrame(docs + [(60, "none")], "doc_id bigint, text string")
    bench = spark.createDataFrame(items + items[:2], "item_id bigint, text string")
    for params in (leaks.LeakParams(), leaks.LeakParams(index_bytes=400)):
        got = leaks.find_leaks(table, bench, params).toPandas()
        pairs = list(zip(got.doc_id, got.item_id))
        assert len(pairs) == len(set(pairs)) and {(i, i // 3) for i in range(12)} | {(50, 0)} <= set(pairs)
        assert {r.doc_id for r in leaks.drop_leaks(table, bench, params).collect()} == {60}


def test_wand_is_exact():
    rng = np.random.default_rng(9)
    items = [(i, _text(rng, int(rng.integers(3, 15)))) for i in range(90)]
    counted = [leaks.words_of(t) for _, t in items]
    df = Counter(w for ws in counted for w in set(ws))
    index = leaks.Index(items, 90, float(np.mean([len(w) for w in counted])), df, leaks.LeakParams(block=4))
    for _ in range(100):
        own = sorted(rng.choice(len(index.vocabulary), 5, replace=False).tolist())
        score = np.zeros(90)
        for t in own:
            score[index.lists[t]] += index.weights[t]
        limit = float(rng.uniform(0.1, 0.6))
        got = index.search(own, limit)
        assert {i for i, _ in got} == set(np.flatnonzero(score >= limit).tolist())


@pytest.mark.parametrize("chain", [1, 2, 30])
def test_components(spark, chain):
    edges = [(i, i + 1) for i in range(chain)] + [(100, 50 + i) for i in range(3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in common.components(df).collect()}
    assert got == {i: 0 for i in range(chain + 1)} | {100: 50, 50: 50, 51: 50, 52: 50}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.jaccard_groups(docs).count() == 0
    assert suffixes.repeated_bytes(docs).count() == 0
    assert chunking.chunk_dedup(docs).count() == 0
    assert lines.line_dedup(docs).count() == 0
    folder = common.new_folder(spark, "ids")
    tokens.write_ids(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.read_ids(spark, folder).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_pipeline_stages(spark, tmp_path, monkeypatch):
    """run() and the rows after each stage against plain Python."""
    import corpus_pipeline

    rng = np.random.default_rng(15)
    items = [(i, _text(rng, 12).capitalize() + " " + _text(rng, 8).capitalize()) for i in range(4)]
    shared = "\n".join(_text(rng, 9) for _ in range(3))
    texts = ["\n".join(_text(rng, 20) for _ in range(4)) for _ in range(60)]
    texts += [" ".join(w.upper() + "!!" for w in rng.choice(WORDS, 60)) for _ in range(60)]
    texts[3] += "\n" + shared
    texts[9] += "\n\n" + shared.replace("\n", "\n\n", 1) + "\nend"
    texts[10] = shared  # nothing is left of it
    texts[11] = texts[2].replace("\n", " ") + " once more"  # a near copy, as lines another text
    texts[12] += " " + items[1][1]
    texts[13] += "\nd\u00e9j\u00e0 vu \U0001f600"
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < 60)) for i in range(len(texts))]
    for name, data, schema in (
        ("documents", rows, "doc_id bigint, text string, n_chars bigint"),
        ("labels", labels, "doc_id bigint, quality int"),
        ("benchmark", items, "item_id bigint, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    seen, plain = {}, corpus_pipeline.stage

    def noted(df, name):
        out = plain(df, name)
        seen[name] = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect())
        return out

    monkeypatch.setattr(corpus_pipeline, "stage", noted)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    want = [r for r in rows if r[0] < 60]
    assert seen["quality_classifier"] == want
    gone, cut = _line_model([r[:2] for r in want]), []
    for i, t, n in want:
        if i in gone:
            left, j = [], -1  # a blank line goes where the lines before and after it go
            for x in t.split("\n"):
                j += bool(x.strip(" "))
                if not (j in gone[i] and (x.strip(" ") or j + 1 in gone[i])):
                    left.append(x)
            t = "\n".join(left)
        if i not in gone or t.strip(" "):
            cut.append((i, t, len(t)))
    assert 10 not in {r[0] for r in cut} and [r for r in cut if r[0] == 9][0][1].endswith(".\n\nend")
    assert seen["line_dedup"] == cut
    sets = _shingle_sets(pd.DataFrame(cut, columns=["doc_id", "text", "n_chars"]))
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    low = _components(sorted(sets), linked)
    single = [r for r in cut if low[r[0]] == r[0]]
    assert 11 not in {r[0] for r in single} and seen["ngram_jaccard_join"] == single
    words = lambda t: b" ".join(leaks.words_of(t))
    clean = [r for r in single if not any(words(t) in words(r[1]) for _, t in items)]
    assert len(clean) == len(single) - 1 and seen["decontamination"] == clean
    assert {i: r.text for i, r in got.items()} == {i: t for i, t, _ in clean}
    model = pieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    for i, t, _ in clean:
        ids = np.frombuffer(model.encode([t])[0], "<i4").tolist()
        assert list(got[i].ids) == ids and got[i].n_pieces == len(ids)


def test_line_dedup_against_its_sql(spark):
    from check_queries import compare

    from sluiceway.llm import queries

    name, folder = "op2_line_dedup", "/root/testdata/sf0.001"
    assert compare(spark, folder, name, queries.queries()[name], queries.oracle_sql()[name]).startswith("ok")
