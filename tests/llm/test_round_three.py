"""The divergence audit, the flat graph and the vector codes against brute force, and rows that no operator may trip over."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from wavelake.llm import decontaminate, divergence, flatgraph, media, queries, simhash, veccodes

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SQL = ["op11_source_divergence", "op12_embedding_near_dedup", "op13_vector_codes"]


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small)
    con = duck.execute(queries.ORACLES[name])
    cols = [c[0] for c in con.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(map(repr, con.fetchall()))


# --- divergence ---------------------------------------------------------------------------------------------------


def audited(rows: list[tuple], least: int, ranks: int) -> list[tuple]:
    """All rows of the audit from a table of each group and kept term."""
    docs = [((lang or ""), (source or ""), TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= least), key=lambda t: t.encode())
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if t in set(kept))
        total = Counter(t for c in count.values() for t in c.elements())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(count[s]) for s in count}
        q = share(total)
        gap = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in count:
            pairs = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("least,ranks", [(1, 3), (2, 10), (3, 10)])
def test_divergence_of_odd_rows(spark, least, ranks):
    rng = random.Random(least)
    words = [*"abcdefgh", "Straße", "ÄPFEL", "äpfel", "日本", "Zoo", "zoo", "x1y", " ", "İ"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ä", None])) for _ in range(60)]
    rows += [(None, "en", "s1"), ("", "en", "empty"), ("123 !? \t\n", "de", "none"), ("lonely words here", "it", "a"), ("other ones there", "it", "b"), ("Word " * 5000, "en", "long"), ("same same", "en", "s2"), ("same same", "en", "s2")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, term int, `n.df` string")
    got = divergence.audit(docs, least, ranks)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == audited(rows, least, ranks)
    assert divergence.audit(docs.limit(0)).count() == 0


# --- flat graph ---------------------------------------------------------------------------------------------------


def linked(rows: list[tuple], least: float = 0.95) -> list[tuple]:
    vec = []
    for _, v in rows:
        good = v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
        vec.append(np.array(v, float) / max(map(abs, v)) if good else None)
    width = max(len(v) for v in vec if v is not None)
    unit = np.stack([np.pad(v / np.linalg.norm(v), (0, width - len(v))) if v is not None else np.zeros(width) for v in vec])
    hit = unit @ unit.T >= least
    np.fill_diagonal(hit, False)
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in np.argwhere(hit):
        up[max(find(a), find(b))] = min(find(a), find(b))
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[find(k)] = min(i, least_id.get(find(k), i))
    return sorted(((i, int(hit[k].sum()), least_id.get(find(k)), i is not None and i == least_id[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def near_groups(rng, n: int, width: int = 16) -> list[list[float]]:
    out = []
    while len(out) < n:
        v = rng.standard_normal(width)
        out += [(v + rng.standard_normal(width) * rng.choice([0.03, 0.15, 0.25])).tolist() for _ in range(rng.choice([1, 1, 1, 2, 5, 40]))]
    return out[:n]


@pytest.mark.parametrize("mean,page", [(750, 4096), (100, 4096), (200, 150)])
def test_flat_graph_finds_all_links(spark, monkeypatch, mean, page):
    """Many links near the threshold, in one shard, in overlapping ones, and in clusters that are cut in pages."""
    monkeypatch.setattr(flatgraph, "MEAN", mean)
    monkeypatch.setattr(flatgraph, "PAGE", page)
    rows = [(i * 3, v) for i, v in enumerate(near_groups(np.random.default_rng(mean + page), 900))]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, `vec.key` string").repartition(3)
    out, recall = flatgraph.near_duplicates(df)
    got, want = sorted((tuple(r) for r in out.collect()), key=repr), linked(rows)
    assert recall >= 0.98
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert true > 2000 and 0.98 * true <= found <= true
    assert sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) >= 0.98 * len(rows)


def test_flat_graph_on_odd_vectors(spark):
    rng = np.random.default_rng(5)
    some = rng.standard_normal(8).tolist()
    rows = [(9, some), (4, some), (4, some), (None, some), (7, [2 * c for c in some]), (1, [-c for c in some]), (2, None), (3, []), (5, [0.0] * 8), (6, [None] * 8), (8, [float("nan")] + some[1:]), (10, [float("inf")] * 8), (11, [1e300] * 8), (12, [1e-300] * 8), (13, some[:4]), (14, some[:4] + [0.0, -0.0, 0.0, 0.0]), (15, [c + 0.01 for c in some])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, _ = flatgraph.near_duplicates(df)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == linked(rows)
    assert flatgraph.near_duplicates(df.limit(0))[0].count() == 0
    assert [tuple(r) for r in flatgraph.near_duplicates(df.where("vec_id = 2"))[0].collect()] == [(2, 0, 2, True)]


# --- vector codes -------------------------------------------------------------------------------------------------


def coded(rows: list[tuple], width: int) -> tuple[dict, list]:
    ok = [(i, v) for i, v, _ in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(Fraction(c) * 4096) for c in v] for _, v in ok]
    order = sorted(range(len(ok)), key=lambda k: (ok[k][0] is None, ok[k][0] or 0, ok[k][1]))
    w = width // 8
    books = [[x[k][w * p : w * p + w] for k in order[:16]] for p in range(8)]

    def assigned():
        for v in x:
            far = [[sum((a - b) ** 2 for a, b in zip(v[w * p : w * p + w], e, strict=True)) for e in books[p]] for p in range(8)]
            yield [d.index(min(d)) for d in far], sum(map(min, far))

    for _ in range(6):
        codes = [c for c, _ in assigned()]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [v[w * p : w * p + w] for v, c in zip(x, codes, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(z) // len(mine) for z in zip(*mine, strict=True)]
    out = defaultdict(list)
    for (i, _), (c, e) in zip(ok, assigned(), strict=True):
        out[i].append((bytes(c).hex(), e if e < 1 << 63 else None))
    return {k: sorted(v, key=repr) for k, v in out.items()}, books


@pytest.mark.parametrize("kind", ["plain", "huge", "few", "tied"])
def test_vector_codes(spark, monkeypatch, kind):
    monkeypatch.setattr(veccodes, "CHUNK", 16 * 70)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], i % 3) for i in range(300 if kind != "few" else 9)]
    if kind == "huge":
        rows += [(None, [0.0] * 16, None), (5, [1e300] * 16, 1), (6, [-3e38] * 8 + [2e9] * 8, None)]
    if kind == "tied":
        rows = [(i, [float(i % 5)] * 8 + [rng.choice([0.0, 0.5]) for _ in range(8)], 1) for i in range(200)]
    rows += [(7, None, 1), (8, [None] * 16, 1), (9, [float("nan")] * 16, 2), (10, [1.0] * 8, 2), (11, [], 2), (12, [1.5] * 16, 2), (12, [1.5] * 16, 2)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, `code.error` string").repartition(3)
    out, books = veccodes.compress(df)
    got = defaultdict(list)
    for r in out.collect():
        got[r.id].append((bytes(r.code).hex(), r.error))
    want, wanted = coded(rows, 16)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == want and [b.tolist() for b in books] == wanted


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [1.0] * 7, 1)], "vec_id long, embedding array<float>, label int")
    assert veccodes.compress(df)[0].count() == 0 and veccodes.compress(df.limit(0))[0].count() == 0


def test_balls_give_their_sums():
    """Most points of separated groups are never compared with an entry: their ball is wholly owned."""
    rng = np.random.default_rng(0)
    centre = rng.integers(-4000, 4000, (16, 8)) * 50
    points = (centre[rng.integers(0, 16, 2000)] + rng.integers(-60, 60, (2000, 8))).astype(np.int64)
    forest = veccodes._Forest(np.stack([points] * 2))
    seen = []
    where, _ = forest.assign([centre, centre], lambda balls, entries: seen.append((forest.last - forest.first)[balls].sum()))
    assert sum(seen) + len(where) == 4000 and sum(seen) > 3500
    total, count = forest.sums([centre, centre])
    near = ((points[:, None] - centre[None]) ** 2).sum(2).argmin(1)
    assert (count[0] == np.bincount(near, minlength=16)).all() and (total[1].sum(0) == points.sum(0)).all()


# --- reproduced faults --------------------------------------------------------------------------------------------


def test_keyframes_are_runs(spark):
    """A track of millions of samples that all are sync samples is some runs."""
    n, per = 5_000_000, 1_000_000
    chunks = 1000 + np.arange(5) * (per + 17)
    track = media.Track()
    track.samples, track.same, track.chunks = n, 1, chunks
    track.stsc, track.stts = np.array([[1, per]]), np.array([[n, 3]])
    runs = track.keyframes()
    assert runs.tolist() == [[1000 + k * (per + 17), 1, 3 * k * per, per, 1, 3] for k in range(5)]
    for seed in range(200):
        rng = np.random.default_rng(seed)
        o, k, t = np.cumsum(rng.integers(1, 3, 11) * 64), rng.integers(1, 3, 11), np.cumsum(rng.integers(1, 3, 11))
        flat = [(a + i * s, b, c + i * d) for a, b, c, m, s, d in media._runs(o, k, t).tolist() for i in range(m)]
        assert flat == list(zip(o.tolist(), k.tolist(), t.tolist(), strict=True))
    content = media.write_media(bytes(range(256)) * 40)
    files = spark.createDataFrame([(1, bytearray(content)), (2, None), (3, bytearray(b"")), (4, bytearray(content[:300]))], "`a.b` long, content binary")
    rows = {r["a.b"]: r for r in media.describe_media(files, "a.b").collect()}
    frames = rows[1].tracks[0].keyframes
    assert sum(f["count"] for f in frames) == 5 and [(f.length, f.step) for f in frames] == [(64, 64 * media.KEYFRAME_EVERY)]
    assert rows[2].tracks is None and rows[3].error and rows[4].error and rows[1].error is None


def test_many_short_items(spark):
    """Twenty thousand items of two words: their shares are kept sparse, all copies are found and nothing else."""
    rng = random.Random(4)
    made = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    items = [(i, f"{made()} {made()}") for i in range(20_000)]
    docs = [(i, f"{made()} {items[i * 37][1]} {made()}" if i % 2 else " ".join(made() for _ in range(5))) for i in range(200)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i * 37) for i in range(200) if i % 2}


def test_dense_groups_are_trees():
    edges = [(i, j) for i in range(30) for j in range(i)] + [(100 + i, 100) for i in range(1, 6)] + [(200 + i, 199 + i) for i in range(1, 20)] + [(101, 101)]
    pair = np.unique(np.array(edges), axis=0)
    got = {tuple(e) for e in simhash._thinned(pair).tolist()}
    assert {e for e in got if e[0] >= 100} == {e for e in edges if e[0] >= 100}
    assert {e for e in got if e[0] < 100} == {(i, 0) for i in range(30)} | {(i, i) for i in range(30)}


def test_names_of_any_kind_through_the_stages(spark, tmp_path):
    import corpus_pipeline

    names = ["x.y", "a`b", "a b", "row", "select", "Ü-1", "text.len"]
    rows = [(i, f"text number {i} says something that differs a lot {i * 7919}", "en", f"s{i % 2}", 9, *([i] * len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "nobody else has written")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
    assert corpus_pipeline.STAGES[4][1](spark, d, str(tmp_path)).count() == d.count() > 0
