"""Brute-force, round-trip and odd-input tests of the llm operators."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sphaera.llm import contamination, knn_tree, queries, similarity_clusters, text_quality, tokenizer, top_n, vectors
from tests.oracle import compare

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, small, name):
    compare(spark, small, queries.QUERIES[name], queries.SQL[name])


# Vectors.


def points(spark, data, within=1.0, name="d"):
    """dataset and catalog tables with a column more than they need, whose names clash with inner ones."""
    rows = [(int(i), n, x, y, DAY, 1) for i, n, x, y in data]
    names = {n for _, n, _, _ in data if n is not None} | {name}
    catalog = [(n, 2, 2, within, DAY, "x") for n in sorted(names)]
    return (
        spark.createDataFrame(rows, "sample_id long, dataset_name string, x array<double>, y int, loaded_at timestamp, rep int"),
        spark.createDataFrame(catalog, "dataset_name string, n_features int, n_classes int, similar_within double, registered_at timestamp, copies string"),
    )


def truth(data, within, k=5):
    """Chains and neighbour pairs by looking at all pairs."""
    ok = {}
    for i, n, x, _ in data:
        if n and x and len(x) == 2 and all(v is not None and math.isfinite(v) for v in x):
            ok[i] = (n, x)
    ids = sorted(ok)
    near = {a: sorted((math.dist(ok[a][1], ok[b][1]), b) for b in ids if b != a and ok[a][0] == ok[b][0] and math.dist(ok[a][1], ok[b][1]) <= within) for a in ids}
    group, chains = {}, set()
    for a in ids:
        if a not in group:
            todo, group[a] = [a], a
            while todo:
                for _, b in near[todo.pop()]:
                    if b not in group:
                        group[b] = a
                        todo.append(b)
    for g in set(group.values()):
        m = sorted(i for i in ids if group[i] == g)
        if len(m) >= 3:
            chains |= set(zip(m[:-1], m[1:]))
    return chains, {(min(a, b), max(a, b)) for a in ids for _, b in near[a][:k]}


def cloud(n=400, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.uniform(0, 60, (25, 2))
    data = [(i, "d" if i % 5 else "e", (centre[rng.integers(25)] + rng.normal(0, 0.8, 2)).round(1).tolist(), i % 3) for i in range(n)]
    data += [(1000 + i, "d", [5.0, 5.0], None) for i in range(40)]  # copies
    data += [(2000, "d", None, 1), (2001, "d", [1.0], 1), (2002, "d", [1.0, float("nan")], 1), (2003, None, [1.0, 1.0], 1), (2004, "unknown2", [None, 1.0], 1), data[3], data[3]]
    return data


@pytest.mark.parametrize("whole,bucket", [(8192, 8192), (20, 8192), (20, 10)])
def test_clusters_equal_all_pairs(spark, whole, bucket):
    data = cloud()
    got = {tuple(r) for r in similarity_clusters.cluster_chain(*points(spark, data), whole=whole, bucket=bucket).collect()}
    assert got == truth(data, 1.0)[0]


@pytest.mark.parametrize("whole,leaf", [(8192, 1024), (50, 16)])
def test_neighbours_equal_all_pairs(spark, whole, leaf):
    data = cloud()
    got = {tuple(r) for r in knn_tree.neighbour_pairs(*points(spark, data), whole=whole, leaf=leaf).collect()}
    want = truth(data, 1.0)[1]
    assert not got - want or len(got - want) <= 0.02 * len(want)
    assert len(got & want) >= 0.98 * len(want)


def test_tree_bounds_never_pass_a_neighbour():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    tree = knn_tree.Tree.unpack(knn_tree.fit_tree(x, 20).pack())
    leaf = tree.leaves(x)
    assert len(np.unique(leaf)) > 20
    rows, leaves, bounds = tree.visits(x[:50], np.full(50, 1.2))
    seen = set(zip(rows.tolist(), leaves.tolist()))
    for i in range(50):
        for j in np.nonzero(np.linalg.norm(x - x[i], axis=1) <= 1.2)[0]:
            assert (i, leaf[j]) in seen


def test_band_keys_meet_for_similar_vectors():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 8, 24):
        x = rng.normal(size=(2000, width)) * 10
        y = x + np.sign(rng.normal(size=(2000, width))) / np.sqrt(width) * 0.999
        met = (similarity_clusters.band_keys(x, 1.0) == similarity_clusters.band_keys(y, 1.0)).any(1)
        assert met.mean() >= 0.999


def test_empty_vectors(spark):
    d, c = points(spark, [])
    assert similarity_clusters.cluster_chain(d, c).isEmpty() and knn_tree.neighbour_pairs(d, c).isEmpty()
    assert similarity_clusters.describe_clusters(d, c).isEmpty()


def test_described_clusters(spark):
    data = [(i, "d", [0.1 * i, 0.0], 1) for i in range(5)] + [(10 + i, "d", [50.0 + 0.9 * i, 0.0], i % 2) for i in range(9)]
    rows = {r.cluster: r for r in similarity_clusters.describe_clusters(*points(spark, data)).orderBy("group_id").collect()}
    assert rows[0].size == 5 and rows[0].agreement == 1.0 and not rows[0].loose and rows[0].typical[0] == 0
    assert rows[10].loose
    groups = similarity_clusters.describe_clusters(*points(spark, data)).where("cluster = 10").collect()
    assert sum(g["size"] for g in groups) == 9


def described(data, within):
    """{group_id: (cluster, size, loose, typical)} by looking at all pairs of samples."""
    ok = {i: (n, tuple(x)) for i, n, x, _ in data if n and x and len(x) == 2 and all(v is not None and math.isfinite(v) for v in x)}
    rep = {i: min(j for j in ok if ok[j] == ok[i]) for i in ok}
    reps = sorted(set(rep.values()))
    near = {a: [b for b in reps if ok[a][0] == ok[b][0] and math.dist(ok[a][1], ok[b][1]) <= within] for a in reps}
    degree = {a: sum(rep[i] in near[a] for i in ok) - 1 for a in reps}
    up = {a: min(near[a], key=lambda b: (-degree[b], b)) for a in reps}
    cluster = {}
    for a in reps:
        todo = [] if a in cluster else [a]
        while todo:
            b = todo.pop()
            if b not in cluster:
                cluster[b] = a
                todo += near[b]
    top = {}
    for a in reps:
        m = a
        while up[m] != m:
            m = up[m]
        top[a] = m
    out = {}
    for c in set(cluster.values()):
        members = [i for i in sorted(ok) if cluster[rep[i]] == c]
        if len(members) < 3:
            continue
        loose = max(degree[rep[i]] for i in members) < 0.5 * (len(members) - 1)
        for g in {top[rep[i]] for i in members} if loose else {None}:
            group = [i for i in members if g is None or top[rep[i]] == g]
            out[min(rep[i] for i in group)] = (c, len(group), loose, sorted(group, key=lambda i: (-degree[rep[i]], i))[:3])
    return out


@pytest.mark.parametrize("whole,bucket", [(8192, 8192), (20, 8192), (20, 10)])
def test_described_clusters_equal_all_pairs(spark, whole, bucket):
    chain = [(3000 + i, "d", [100.0 + 0.3 * i, 0.1 * (i % 3)], i % 2) for i in range(60)]
    tight = [(4000 + i, "d", [300.0 + 0.01 * i, 0.0], 1) for i in range(50)]
    data = cloud() + chain + tight
    got = {r.group_id: (r.cluster, r["size"], r.loose, r.typical) for r in similarity_clusters.describe_clusters(*points(spark, data), whole=whole, bucket=bucket).collect()}
    want = described(data, 1.0)
    assert got == want and {loose for _, _, loose, _ in want.values()} == {True, False}


def test_copies_count_in_degrees(spark):
    data = [(i, "d", [5.0, 5.0], 1) for i in range(4)] + [(10 + i, "d", [50.0 + 0.5 * (i % 2), 0.0], 1) for i in range(4)]
    data += [(20 + i, "d", [100.0 + 0.9 * i, 0.0], 1) for i in range(5)] + [(30 + i, "d", [103.6, 0.0], 1) for i in range(4)]
    got = {r.group_id: (r.cluster, r["size"], r.loose, r.typical) for r in similarity_clusters.describe_clusters(*points(spark, data)).collect()}
    assert got == described(data, 1.0) == {0: (0, 4, False, [0, 1, 2]), 10: (10, 4, False, [10, 11, 12]), 20: (20, 9, False, [23, 24, 30])}


def test_exact_and_near_agree_at_the_edge():
    a = np.array([[0.0, 0.0], [0.3, 0.4]])
    assert vectors.near(a, a, 0.5)[0, 1] and not vectors.near(a, a, np.nextafter(0.5, 0))[0, 1]


# Top N.


def settings_table(spark, rows):
    return spark.createDataFrame(rows, "grid_id long, dataset string, algorithm string, success_runs int, acc_mean double, nmi_mean double, f_measure_mean double, runtime_seconds_mean double, summarised_at timestamp, g long, s0 string")


def best_by_sorting(rows, n=3):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or (r[8] or dt.datetime.min) >= (last[r[0]][8] or dt.datetime.min)):
            last[r[0]] = r
    groups = {}
    for r in last.values():
        if r[3] == 3 and r[4] is not None and r[4] == r[4]:
            groups.setdefault((r[1], r[2]), []).append(r)
    miss = lambda v: (1, 0.0) if v is None or v != v else (0, v)
    out = set()
    for g in groups.values():
        g.sort(key=lambda r: (-r[4], miss(None if r[5] is None else -r[5]), miss(None if r[6] is None else -r[6]), miss(r[7]), r[0]))
        out |= {(r[0], i + 1) for i, r in enumerate(g[:n])}
    return out


@pytest.mark.parametrize("rows_per_group", [20000, 7])
def test_best_settings_equal_sorting(spark, rows_per_group):
    rng = random.Random(1)
    nan = float("nan")
    rows = []
    for i in range(600):
        group = ("big", "a") if i % 3 == 0 else (rng.choice(["x", "y", None]), rng.choice("abc"))
        row = (i, *group, rng.choice([3, 3, 3, 2, None]), rng.choice([0.5, 0.6, 0.7, nan, None]), rng.choice([0.1, 0.2, nan, None]), rng.choice([0.1, nan, None]), rng.choice([1.0, 2.0, nan, None]), DAY, i, "s")
        rows.append(row)
        if i % 7 == 0:
            rows.append((*row[:4], rng.choice([0.9, 0.1, None]), *row[5:8], DAY + dt.timedelta(days=1), i, "s"))
        if i % 11 == 0:
            rows.append(row)
    rows.append((None, "x", "a", 3, 0.99, 0.1, 0.1, 1.0, DAY, 1, "s"))
    got = {(r.grid_id, r.rank_no) for r in top_n.best_settings(settings_table(spark, rows), rows_per_group=rows_per_group).collect()}
    assert got == best_by_sorting(rows)


def test_row_groups_are_skipped(spark, monkeypatch):
    rows = [(i, "big", "a", 3, i / 1000, 0.1, 0.1, 1.0, DAY, 1, "s") for i in range(900)]
    read = []
    real = top_n._reader

    def spy(columns):
        inner = real(columns)

        def run(batches):
            return inner(batches)

        read.append(columns)
        return run

    monkeypatch.setattr(top_n, "_reader", spy)
    got = {(r.grid_id, r.rank_no) for r in top_n.best_settings(settings_table(spark, rows), rows_per_group=10).collect()}
    assert got == {(899, 1), (898, 2), (897, 3)}
    assert len(read) == 1  # all but the first row groups were ruled out by their statistics


def test_top_n_of_nothing(spark):
    assert top_n.best_settings(settings_table(spark, [])).isEmpty()


# Tokens.


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.encoder(tokenizer.default_vocabulary(), tokenizer.default_pattern())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_tokens_equal_the_public_encoding_and_come_back(text):
    import tiktoken

    e = tokenizer.encoder(tokenizer.default_vocabulary(), tokenizer.default_pattern())
    ranks = {t: i for i, t in enumerate(e.tokens)}
    plain = tiktoken.Encoding("plain", pat_str=tokenizer.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    assert e.encode(text) == plain.encode_ordinary(text)
    assert e.decode(e.encode(text)) == text


def test_long_and_special_texts(encoder):
    for text in ("a" * 30000, " " * 5000, "<|endoftext|>", "é█\x00\n" * 500, "日本語" * 800):
        assert encoder.decode(encoder.encode(text)) == text
    assert encoder.encode("") == [] and encoder.encode(None) == []


def test_forgetting_known_words_changes_nothing(encoder, monkeypatch):
    text = "one two three four five six seven"
    before = encoder.encode(text)
    monkeypatch.setattr(tokenizer, "REMEMBERED", 0)
    assert encoder.encode(text + " eight") [: len(before)] == before and encoder.encode(text) == before


def test_corpus_rows(spark):
    df = spark.createDataFrame([(1, "hi there", 0), (2, None, 0), (3, "", 0), (1, "hi there", 0)], "doc_id long, text string, ids int")
    rows = sorted((r.doc_id, r.ids) for r in tokenizer.encode_corpus(df).collect())
    assert len(rows) == 4 and rows[2:] == [(2, []), (3, [])] and rows[0] == rows[1] and len(rows[0][1]) == 2
    assert tokenizer.encode_corpus(df.limit(0)).isEmpty()


# Leaks.


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(n)]


PASSAGE = words(1, 80)


def leaks(text):
    return contamination.PassageIndex([(7, " ".join(PASSAGE))]).leaked(text) == [7]


def test_length_and_exchange_limits():
    around = lambda w: " ".join([*words(2, 50), *w, *words(3, 50)])
    assert leaks(around(PASSAGE[10:40])) and not leaks(around(PASSAGE[10:39]))
    swapped = PASSAGE[10:50]
    for i in (4, 12, 20, 28, 36):
        swapped[i] = "zzz"
    assert leaks(around(swapped))
    for i in (8, 16, 24, 32):
        swapped[i] = "████"
    assert not leaks(around(swapped))


def test_layout_does_not_matter():
    w = PASSAGE[5:45]
    text = " ".join(w[:7]).upper() + "\n[2]\x0c\nCourt of X, CIV 12/1999   Page 2 of 5\n" + " ".join(w[7:15]) + ",\r\n(7) \t" + "\xa0".join(w[15:22])
    text += " " + w[22][:2] + "-\n" + w[22][2:] + " <p>\n" + w[23][:2] + "\xad" + w[23][2:] + " “" + "; ".join(w[24:]) + "”"
    assert leaks(text)


def test_missing_words_count_as_exchanged():
    w = PASSAGE[5:20] + PASSAGE[22:50]
    assert leaks(" ".join(w))
    assert not leaks(" ".join(PASSAGE[:15]) + " " + " ".join(words(9, 300)) + " " + " ".join(PASSAGE[15:30]))


def test_masks_meet_every_worst_case():
    for seed in range(200):
        rng = random.Random(seed)
        w = list(PASSAGE[20:50])
        for i in rng.sample(range(1, 29), 3):  # an exchanged word at an end is a shorter quotation
            w[i] = "zzz"
        assert leaks(" ".join([*words(seed, 10), *w, *words(seed + 1, 10)]))


def test_leaked_items_in_blocks_and_odd_rows(spark):
    text = " ".join(PASSAGE)
    docs = spark.createDataFrame([(1, text, 1), (1, text, 1), (2, None, 1), (3, " \n", 1), (None, text, 1), (4, "short", 1), (5, "x " * 20000 + text, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, text, "p"), (7, text, "p"), (8, None, "p"), (None, text, "p"), (9, "few words", "p"), (10, " ".join(words(5, 90)), "p")], "item_id long, passage string, doc_id string")
    for block in (16_000_000, 300):
        got = sorted(map(tuple, contamination.leaked_items(docs, items, block_chars=block).collect()))
        assert got == [(1, 7), (5, 7)]
    assert contamination.leaked_items(docs.limit(0), items).isEmpty() and contamination.leaked_items(docs, items.limit(0)).isEmpty()


# Text quality.

PROSE = "The court was of the view that the lease had been signed and the rent was not to be paid by the tenant before it was due."
CASES = {
    None: [PROSE, PROSE + "\n1. sale | 13\n2. lease | 14", "The appeal is dismissed and the appellant shall bear the costs.", "Der Zeuge hat die Fristen und die Anträge als unklar bezeichnet, und das Gericht ist dem gefolgt.", "", " \n", None],
    "list": ["Index\n" + "\n".join(f"{i}. Ms {w.title()}" for i, w in enumerate(words(4, 20))), "\n".join(f"• {w} matter" for w in words(6, 20))],
    "table": ["\n".join(f"| {w} | {i * 37} | £{i},000 |" for i, w in enumerate(words(4, 15))), "\n".join(f"{w}\t{i}\t{i * 1.5}" for i, w in enumerate(words(5, 15)))],
    "junk": ["lease - " * 60, "^%$#@!~" * 40, "\n".join(f"{i * 16:08x}  " + " ".join(f"{(i * 7 + j * 31) % 256:02x}" for j in range(16)) for i in range(20))],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in CASES.items() for t in ts])
def test_kinds(kind, text):
    assert text_quality.outcome(*text_quality.Partial.of(text or "").finish()) == kind


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab the\n\r\t|;.A1█ ", max_size=400), st.randoms(use_true_random=False))
def test_chunks_in_any_tree_give_the_same(text, rng):
    cuts = text_quality.cut_points(text, 24)
    ends = [a for a, _ in cuts[1:]] + [len(text)]
    if any(broken for _, broken in cuts):
        return  # words longer than a chunk; see test_words_longer_than_a_chunk
    parts = [text_quality.Partial.of(text[a:e], b) for (a, b), e in zip(cuts, ends)]
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i].join(parts[i + 1])]
    assert parts[0].finish() == text_quality.Partial.of(text).finish()


def test_words_longer_than_a_chunk():
    text = "the " + "x" * 20000 + " the " + "y" * 9000
    cuts = text_quality.cut_points(text, 5000)
    ends = [a for a, _ in cuts[1:]] + [len(text)]
    total = None
    for (a, b), e in zip(cuts, ends):
        one = text_quality.Partial.of(text[a:e], b)
        total = one if total is None else total.join(one)
    assert total.finish()[0] == text_quality.Partial.of(text).finish()[0]


def test_statistics_of_odd_rows_and_chunks(spark):
    rows = [(1, PROSE, 1), (1, PROSE, 1), (2, None, 1), (3, "", 1), (None, "x", 1), (4, (PROSE + "\r\n") * 30, 1), (5, "lease " * 400, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sums int")
    a = sorted(map(tuple, text_quality.text_statistics(df).collect()), key=str)
    b = sorted(map(tuple, text_quality.text_statistics(df, chunk=200).collect()), key=str)
    assert a == b and len(a) == 5
    by = {r[0]: r for r in a}
    assert by[2][1:] == (0, 0, None, None, 0, None, None, None) and by[4][5] == 30 and by[5][-1] == "junk"
    assert text_quality.not_prose(df.limit(0)).isEmpty()
    assert sorted(map(tuple, text_quality.not_prose(df).collect())) == [(4, "junk"), (5, "junk")]  # one sentence over and over is junk too


def test_the_core_does_not_import_this_package():
    import pathlib

    import sphaera

    root = pathlib.Path(sphaera.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "sphaera.llm" not in f.read_text()


@pytest.mark.parametrize("whole,leaf", [(10_000, 8), (20, 8)])
def test_exact_search_equals_all_pairs_whatever_the_parts(spark, monkeypatch, whole, leaf):
    monkeypatch.setattr(knn_tree, "PART", 5)
    monkeypatch.setattr(knn_tree, "VISITORS", 9)
    data = cloud()
    got = {tuple(r) for r in knn_tree.neighbour_pairs(*points(spark, data), whole=whole, leaf=leaf, exactly=True).collect()}
    assert got == truth(data, 1.0)[1]


def test_datasets_of_one_task_are_searched_by_their_tree():
    rng = np.random.default_rng(8)
    x, ids = rng.normal(size=(3000, 6)), rng.permutation(3000)
    tree = knn_tree.fit_tree(x, knn_tree.LOCAL_LEAF)
    own = tree.leaves(x)
    members = {int(leaf): np.nonzero(own == leaf)[0] for leaf in np.unique(own)}
    assert len(members) > 20
    rows = np.arange(0, 3000, 7)
    i, other, d = knn_tree.nearest(x[rows], ids[rows], x, ids, np.full(len(rows), 1.5), 5)
    want = set(zip(rows[i].tolist(), other.tolist()))
    for budget in (None, 4):
        distance, found, visit = knn_tree.searched(tree, x, ids, members, rows, 1.5, 5, budget)
        a, b = np.nonzero(np.isfinite(distance))
        got = set(zip(rows[a].tolist(), found[a, b].tolist()))
        assert got == want if budget is None else len(got & want) >= 0.8 * len(want)
        if budget is None:
            visits = knn_tree.widened(visit, np.isfinite(distance))
            assert visits & (visits - 1) == 0 and (visit < visits).sum() >= knn_tree.TARGET * len(a)


def test_queues_give_leaves_in_the_order_of_their_bounds_and_stop_at_the_nearest_found():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 3))
    tree = knn_tree.fit_tree(x, 16)
    most, seen = np.full(40, 10.0), {i: [] for i in range(40)}

    def meet(leaf, rows, visits):
        for r, v in zip(rows.tolist(), visits.tolist()):
            assert v == len(seen[r])
            seen[r].append(leaf)
        most[rows] = 0.0

    tree.best_first(x[:40], most, None, meet)
    own = tree.leaves(x[:40])
    assert all(own[i] in leaves and len(leaves) <= 3 for i, leaves in seen.items())
    rows, _, visit = tree.visits(x[:40], np.full(40, 10.0), 5)
    assert np.bincount(rows).tolist() == [5] * 40 and visit.max() == 4


def test_the_query_skips_row_groups_that_mix_groups(spark, small):
    report: dict[str, int] = {}
    summary = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/grid_summary.parquet")
    got = {(r.grid_id, r.rank_no) for r in top_n.best_settings(summary, report=report).select("grid_id", "rank_no").collect()}
    assert got == {(r.grid_id, r.rank_no) for r in queries.p4_found(spark, small.replace("sf0.001", "sf0.01")).collect()}
    assert 0 < report["read"] < report["row_groups"]


def test_letters_as_noise_and_words_of_no_language_are_junk():
    prose = "The judge plainly raised the customary toll, but it was restricted by the order and should not be advanced. " * 3
    kind = lambda t: text_quality.outcome(*text_quality.Partial.of(t).finish())
    assert kind(prose) is None
    assert kind("".join("Ã" + c for c in prose)) == "junk"
    assert kind("Tiqguzurn nyx sahyxhe do vyrnrofeq nogylptolp negoqsalpfox befevuq pylpwutelp. Waqdulalpcyx rirnwarnpiq lylplanuqz de xyrnbeqwepoq. " * 4) == "junk"
    assert kind("\n".join(f"Re Kirdegard [1999] 43 TCA Rep {i} at [61]" for i in range(20))) == "list"


def test_the_same_words_over_and_over_are_junk_at_every_size():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    text = ". ".join(" ".join(["the", "claim", "of", *words[k : k + 12], "and", "was", "not"]) for k in range(0, 600, 12))
    kind = lambda t: text_quality.outcome(*text_quality.Partial.of(t).finish())
    assert kind(text) is None
    assert kind("\n".join([text] * 12)) == "junk"
    _, distinct = text_quality.Partial.of(text).finish()
    assert 0.8 * 606 < distinct < 1.25 * 606


def test_spread_chunks_give_the_same_rows(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda **k: sorted(map(tuple, text_quality.document_sums(df, **k).distinct().collect()), key=str)
    assert rows(chunk=400, spread=900) == rows(chunk=400, spread=1 << 30) == rows(chunk=1 << 30)
