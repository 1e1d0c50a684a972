"""Alignment, the manifest and the search against brute force, with odd rows."""

import hashlib
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from check_queries import compare
from pyspark.sql import functions as F

import __spark_entry__ as E
from sluiceway.llm import align, merkle, neighbours, queries

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "  a  b\n c", "tab\t b \t", " lead", "trail ", "日本 語 \U0001f600", "a\n b", "it's 12 34a", "▁",
    "a ▁b c", "x\n\n\ny  z", "<|endoftext|> <s> </s>", "<0x0A> a", "\x85 a\x1c b", "é x", "a b   c", "a b   c",
    "mill " * 3000, "m" * 5000,
]


# --- alignment --------------------------------------------------------------------


def _tokens(text):
    """(ids, ends) of both vocabularies, None where one does not spell the text."""
    both = align.aligner(FIRST, SECOND)
    raw = b" " + text.encode()
    out = []
    for ids, spelled in (
        (both.a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes),
        (both.b.encode(text), both.b_bytes),
    ):
        parts = [spelled[i] for i in ids]
        if b"".join(parts) != raw:
            return None
        out.append((ids, np.cumsum([len(p) for p in parts]).tolist()))
    return out


def _aligned(texts):
    docs, count = [], Counter()
    for text in texts:
        found = _tokens(text) if text else None
        if not found:
            docs.append(None)
            continue
        (a, a_ends), (b, b_ends) = found
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            x = a_ends.index(cut, i) + 1
            y = b_ends.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        docs.append((len(a), len(b), groups, links))
        count.update(links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        out.append((
            n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
            sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return out


def test_alignment_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "ROOM", 50)
    monkeypatch.setattr(align, "LINKS", 64)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "1 AS i", "'x' AS t", "2 AS bag", "3 AS n_links"
    )
    got = align.align_documents(docs.repartition(3), FIRST, SECOND)
    want = Counter((i, *w) for (i, _), w in zip(rows, _aligned([t for _, t in rows])))
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_alignment_of_the_smallest_table(spark):
    rows = spark.read.parquet(f"{E.SMOKE}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_cross_tokenizer_alignment(spark, E.SMOKE).collect()}
    assert got == dict(zip((r["doc_id"] for r in rows), _aligned([r["text"] for r in rows])))


def test_pairs_stay_within_their_bound():
    both = align.aligner(FIRST, SECOND)
    ends = {}
    for i, b in enumerate(both.b_bytes):
        ends.setdefault(b, []).append(i)
    firsts = set(both.a_bytes)
    pairs = sum(len(ends.get(x[k:], ())) for x in both.a_bytes for k in range(len(x)))
    pairs += sum(y[k:] in firsts for y in both.b_bytes for k in range(1, len(y)))
    assert 0 < pairs <= both.most_pairs


@pytest.mark.parametrize("a, b", [([1, 2, 3], [3]), ([3], [1, 2, 3]), ([2, 4, 6, 8], [1, 3, 5, 7, 8]), ([2, 5, 9], [2, 7, 9])])
def test_pointers_end_where_both_end(a, b):
    last = align.terminals(np.array(a), np.array(b))
    both = sorted(set(a) & set(b))
    for end, t in zip([*a, *b], last.tolist()):
        assert t >= len(a) and b[t - len(a)] == min(c for c in both if c >= end)


# --- manifest ---------------------------------------------------------------------


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _form(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _rise(nodes):
    tree = [nodes]
    while len(tree[-1]) > 1:
        tree.append([_h(*tree[-1][i : i + 3]) for i in range(0, len(tree[-1]), 3)])
    return tree


def _steps(tree, i):
    out = []
    for level in tree[:-1]:
        a = i - i % 3
        out.append((level[a:i], level[i + 1 : a + 3]))
        i //= 3
    return out


def _manifest(rows, lost):
    """Rows (doc_id, source, lang, n_chars, text) of distinct order; `lost(doc_id)` rows lose line ends."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r, _h(*map(_form, r))))
    trees = {}
    for s, leaves in sources.items():
        leaves.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = _rise([h for _, h in leaves])
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    top = _rise([trees[s][-1][0] for s in order])
    root = top[-1][0]
    out = []
    for s, leaves in sources.items():
        for i, (r, leaf) in enumerate(leaves):
            steps = _steps(trees[s], i) + _steps(top, order.index(s))
            at = leaf
            if lost(r[0]) and r[4] is not None:
                at = _h(*map(_form, (*r[:4], r[4].replace("\n", ""))))
            for left, right in steps:
                at = _h(*left, at, *right)
            proof = _h(*(x for left, right in steps for x in (*left, *right)))
            out.append((r[0], leaf, trees[s][-1][0], root, proof, at, at == root))
    return sorted(out, key=repr)


def _lost(i):
    return i is not None and zlib.crc32(str(i).encode()) % 2 == 0


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_against_plain_trees(spark, levels):
    rng = np.random.default_rng(5)
    rows = [(i, "hot", "en", 3, f"line {i}\nmore") for i in range(100)]
    rows += [(200 + i, [None, "é", "a", "z"][int(rng.integers(4))], None, i, "x\ny" if i % 2 else "plain") for i in range(30)]
    rows += [(400, "", "de", None, None), (401, "one", "fr", 0, ""), (402, None, None, None, "long\n" * 20_000)]
    rows += [(None, "hot", None, 1, "no id\n"), (7, "hot", "en", 3, "line 7\nagain"), (7, "hot", "en", 3, "line 7\nmore")]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    docs = spark.createDataFrame(rows, schema).selectExpr(
        "*", "1 AS g", "2 AS pos", "3 AS node", "'y' AS found", "4 AS name", "5 AS block"
    ).repartition(5)
    lost = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = docs.withColumn(
        "_leaf", merkle.row_digest(*(text if c == "text" else F.col(c) for c in merkle.FIELDS))
    )
    got = sorted((tuple(r) for r in merkle.manifest(docs, changed, levels).collect()), key=repr)
    assert got == _manifest(rows, _lost)
    assert merkle.manifest(docs, levels=levels).where("NOT verified").isEmpty()


@pytest.mark.parametrize("n", [0, 1, 3])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", 1, "a\nb") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr)
    assert got == (_manifest(rows, lambda i: False) if n else [])


def test_manifest_against_its_sql(spark):
    name = "op12_merkle_manifest"
    assert compare(spark, E.SMOKE, name, queries.queries()[name], queries.oracle_sql()[name]).startswith("ok")


# --- nearest neighbours -----------------------------------------------------------


def _true(ids, x, k):
    """(query, [(vec_id, score)]) by comparing all, scores to 12 places for ties."""
    for q in sorted(set(ids[ids % 5 == 0])):
        own = min((tuple(v) for v in x[ids == q]))
        score = np.round(x @ np.array(own), 12)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        yield q, [(int(ids[i]), score[i]) for i in order]


def _vectors(spark, ids, x, odd=()):
    rows = [(int(i), [float(c) for c in v], "l") for i, v in zip(ids, x)]
    df = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<double>, leaf string")
    return df.selectExpr("*", "1 AS v", "2 AS e", "3 AS part").repartition(4)


ODD_VECTORS = [
    (1000, None, "l"), (1005, [], "l"), (1010, [0.0] * 8, "l"), (1015, [float("nan")] * 8, "l"),
    (1020, [1.0, None] * 4, "l"), (1025, [float("inf")] * 8, "l"), (None, [1.0] * 8, "l"),
]


def _search(df, params):
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 5 == 0, params).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return got


def test_search_finds_what_recall_asks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8)) * rng.uniform(0.2, 3.0, (900, 1))
    x[600:] = x[0]  # a third of all rows are copies
    ids = np.arange(900)
    params = neighbours.SearchParams(k=10, leaf_rows=20, branches=4, block=64, trials=40)
    got = _search(_vectors(spark, ids, x, ODD_VECTORS), params)
    hits = total = 0
    for q, want in _true(ids, x, 10):
        mine = got.pop(int(q))
        assert [r for *_, r in mine] == list(range(1, 11))
        hits += len({v for v, *_ in mine} & {v for v, _ in want})
        total += 10
        for v, score, _ in mine:
            assert v != q and score == pytest.approx(x[ids == q][0] @ x[ids == v][0], rel=1e-12)
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0]))
    assert not got and hits >= 0.9 * total


def test_search_that_opens_every_leaf_is_exact(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((300, 8)), 1)
    x[100:140] = x[5]
    ids = np.concatenate([np.arange(290), np.full(10, 40)])  # an id that repeats
    params = neighbours.SearchParams(k=7, leaf_rows=16, branches=3, block=50, recall=1.1)
    got = _search(_vectors(spark, ids, x), params)
    for q, want in _true(ids, x, 7):
        mine = got[int(q)]
        assert [v for v, *_ in mine] == [v for v, _ in want]
        assert np.allclose([s for _, s, _ in mine], [s for _, s in want])


def test_search_with_few_candidates(spark):
    ids, x = np.arange(4), np.eye(8)[:4] + 0.1
    got = _search(_vectors(spark, ids, x), neighbours.SearchParams(leaf_rows=1, branches=2))
    assert [v for v, *_ in got[0]] == [1, 2, 3]
    short = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "vec_id bigint, embedding array<double>")
    assert _search(short, neighbours.SearchParams()) == {0: [(1, 3.0, 1)]}
    for odd in ([], ODD_VECTORS):
        assert _search(_vectors(spark, [], [], odd), neighbours.SearchParams()) == {}


# --- helper columns that clash ------------------------------------------------------


def test_columns_of_any_name(spark):
    from sluiceway.llm import jaccard, lines, pieces

    body = "\n".join(f"line number {i} of the weir" for i in range(5))
    df = spark.createDataFrame([(1, body), (2, body), (3, None), (4, "")], "doc_id bigint, text string")
    odd = df.selectExpr(
        "*", "1 AS __gone", "2 AS __i", "3 AS ___t", "4 AS line_dedup_lines", "5 AS __drop", "6 AS i", "7 AS t"
    )
    plain = {r["doc_id"]: tuple(r)[1:] for r in lines.line_dedup(df).collect()}
    cut = lines.line_dedup(odd)
    assert cut.columns.count("line_dedup_lines") == 1 and {"__gone", "__i", "___t"} <= set(cut.columns)
    for r in cut.collect():
        assert (r["text"], r["line_dedup_lines"], r["line_dedup_removed"], r["line_dedup_runs"]) == plain[r["doc_id"]]
        assert (r["__gone"], r["__i"], r["___t"]) == (1, 2, 3)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    both = pieces.encode_and_decode(odd, SECOND).collect()
    alone = {r["doc_id"]: r["ids"] for r in pieces.encode_documents(odd, SECOND).collect()}
    assert {r["doc_id"]: r["ids"] for r in both} == alone
    assert {r["doc_id"]: r["text"] for r in both} == {1: body, 2: body, 3: "", 4: ""}
    assert all(r["n_pieces"] == len(r["ids"]) for r in both)
