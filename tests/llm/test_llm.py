"""The operators of the subpackage against brute force, and on nulls, empty and long texts, ties and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import rows_of
from pyspark.sql import functions as F

from wavelake.llm import decontaminate, langid, lmscore, media, mixing, queries, simhash, tokens, toxicity, url_filter
from wavelake.llm.common import blocks, connected_components, text_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fold int, tag int, _h int, _id string, _p string, _tag long, `row` int, key int, __row_key string"


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [(1, "The quick brown Fox", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "de"), (None, "der schnelle Fuchs", "de"), (5, long_text, "en"), (6, "a b c", "fr"), (6, "a b c", "fr"), (6, "a b d", "fr"), (7, "12 ## 34", None), (8, "éÉ ñ ß 中文", "es"), (None, None, None)]
    rows = [(i, t, x, None if i == 7 else f"s{(i or 0) % 3}", None, "x", 1, 2, 3, "i", "p", 4, 5, 6, "k") for i, t, x in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return dict((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


# --- shared parts -------------------------------------------------------------------------------------------------


def test_blocks_hold_the_limit_and_all_rows():
    import pyarrow as pa

    t = ["", "abc", "x" * 50, None, "yy", "z" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(t)], names=["doc_id", "text"])
    for limit in (1, 5, 60, 1000):
        got = list(blocks([batch.slice(0, 4), batch.slice(4)], limit=limit))
        assert [x for b in got for x in b.column("doc_id").to_pylist()] == list(range(6))
        for b in got:
            data, o = text_bytes(b)
            assert [data[i:j].tobytes().decode() for i, j in zip(o[:-1], o[1:], strict=True)] == [x or "" for x in b.column("text").to_pylist()]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(900, 900)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame([*edges, (None, 5)], "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- 1: language model --------------------------------------------------------------------------------------------


def test_lm_base_scores_equal_brute_force(docs, texts):
    got = {r.doc_id: r for r in lmscore.score(docs).collect()}
    toks = {i: WORD.findall(lower(t)) + [None] for i, t in texts.items()}
    c = Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores_equal_brute_force(spark, small, docs, texts):
    """Scores of the registered query, from counts in dictionaries and tuples of words."""
    got = {r.doc_id: r.score for r in lmscore.query(spark, small).collect()}
    toks = {i: [*WORD.findall(lower(t)), "</end>"] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}
    full = {i: ["<s>", "<s>", *t] for i, t in toks.items()}

    def gram(i, at, k):  # at the start of a text a context is the start alone
        words = tuple(full[i][at + 3 - k : at + 3])
        return words if at >= k - 1 else ("<s>", *words[k - 1 - at :])

    count = {k: {w: Counter(gram(i, at, k) for i, t in toks.items() if fold[i] != 2 and (w == "all" or fold[i] != 3) for at in range(len(t))) for w in ("all", "kept")} for k in (1, 2, 3)}
    starts = {"all": sum(f != 2 for f in fold.values()), "kept": sum(f not in (2, 3) for f in fold.values())}
    n, v = sum(count[1]["all"].values()), len(count[1]["all"])

    def estimate(i, at, w):
        p = [1 / (v + 1), count[1][w][gram(i, at, 1)] / n]
        for k in (2, 3):
            context = count[k - 1][w][gram(i, at - 1, k - 1)] if at else starts[w]
            p.append(count[k][w][gram(i, at, k)] / context if context else 0.0)
        return p[::-1], min(math.ceil(math.log2(context + 1)), lmscore.BUCKETS - 1)

    held = [estimate(i, at, "kept") for i, t in toks.items() if fold[i] == 3 for at in range(len(t))]
    cells = Counter(lmscore.cells_of(np.array([p[:-1] for p, _ in held]), np.array([b for _, b in held])).tolist())
    weights = lmscore.weights_of(cells, 3, v)
    for i, t in toks.items():
        want = sum(math.log10(float(weights[b] @ np.array(p))) for p, b in (estimate(i, at, "all") for at in range(len(t))))
        assert got[i] == pytest.approx(want, rel=1e-9), i
    small_blocks = {r.doc_id: r.score for r in lmscore.score(docs, block_bytes=15_000).collect()}  # some 30 blocks
    assert small_blocks == pytest.approx(got, rel=1e-9)


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for top in (1, 200, 70_000, 1 << 40, (1 << 64) - 1):
        for n in (0, 1, 5, 3000):
            x = rng.integers(0, top, n, np.uint64, endpoint=True)
            assert lmscore.unpacked(lmscore.packed(x)).tolist() == x.tolist()


def test_lm_scores_are_chances(spark):
    """Scores of short texts are chances, an unseen word has the least, and learned weights sum to one."""
    train = [(i, t) for i, t in zip([i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2], ["a b a c", "a b b", "c a", "b a b"] * 5)]
    held = [i for i in range(10_000, 10_200) if zlib.crc32(str(i).encode()) % 7 == 2]
    probe = list(zip(held, ["a", "b", "c", "unseen"]))
    got = {r.doc_id: r for r in lmscore.score(spark.createDataFrame(train + probe, "doc_id long, text string")).collect()}
    # of "word, end": the chance of the word at the start times that of the end after it
    known = [10 ** got[i].score for i, _ in probe]
    assert all(0 < p < 1 for p in known) and known[3] < min(known[:2])
    assert [got[i].n_known for i, _ in probe] == [2, 2, 2, 1]
    w = lmscore.learn_weights(np.array([5.0, 1.0]), np.array([[0.5, 0.1, 0.01], [0.0, 0.2, 0.01]]), np.array([1, 1]))
    assert w.sum(1) == pytest.approx(np.ones(len(w)))
    assert w[1, 0] > w[1, 2]


def test_lm_odd_rows(odd, none):
    got = lmscore.score(odd).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert lmscore.score(none).count() == 0


# --- 2: SimHash ---------------------------------------------------------------------------------------------------


def fingerprint(t: str | None, width: int = 3) -> int:
    w = WORD.findall(lower(t or ""))
    sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code():
    words, leaders = simhash.golay()
    assert min(int(w).bit_count() for w in words[1:]) == 7 and (leaders >= 0).all()
    assert (simhash.codeword_index(words) == np.arange(4096)).all()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000)
    y = x ^ (1 << rng.integers(0, 23, 3000))
    (i, _), (j, n) = simhash.nearby_indices(x), simhash.nearby_indices(y)
    assert all(a in b[:k] for a, b, k in zip(i[:, 0], j, n, strict=True))


def test_simhash_equals_brute_force(spark, docs, texts, odd):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fp
    assert [r.fp % 2**64 for r in simhash.fingerprints(odd).collect()] == [fingerprint(r.text) for r in odd.collect()]


@pytest.mark.parametrize("crowd", [1, 256])
def test_links_connect_all_within_two_bits(spark, crowd):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b for b in base} | {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)}
    fps |= {b ^ (1 << k) for b in base[:2] for k in range(64)}
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                up[max(find(a), find(b))] = min(find(a), find(b))
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowd)
    pairs = links.collect()
    assert all(((r.src ^ r.dst) % 2**64).bit_count() <= 2 for r in pairs)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert all(got.get(x, x) == find(x) for x in fps)


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    empty = {r.component_id for r in got if r.fp == 0}
    assert empty == {2}
    assert simhash.near_duplicates(none).count() == 0


def shingles(t, width=5):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def test_near_copies_keep_one(spark, texts):
    rng = random.Random(3)
    rows = [(i, t) for i, t in sorted(texts.items()) if len(t.split()) > 60][:40]
    more = []
    for i, t in rows[:20]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        more += [(1000 + i, " ".join(w)), (2000 + i, t.upper() if t.isascii() else t)]
    docs = spark.createDataFrame([(*r, "k") for r in rows + more] + [(rows[0][0], rows[0][1], "k")], "doc_id long, text string, id string")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    group = {r.doc_id: r.group for r in simhash.similar_groups(docs).collect()}
    for a in sets:
        for b in sets:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.8:
                assert group[a] == group[b]
            elif j < 0.05 and a < b:
                assert group[a] != group[b]
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(group.values()))
    assert all(r.doc_id == min(i for i in group if group[i] == group[r.doc_id]) for r in kept)


def test_near_copies_are_found_at_any_length(spark):
    """Recall of pairs of a Jaccard similarity of 0.8 or more, of 12 to 800 words, by three kinds of change."""
    rng, rows, pairs = random.Random(1), [], []
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for n in (12, 20, 40, 80, 200, 800):
        k = 0
        while k < 60:
            w, kind, part = new(n), rng.randrange(3), rng.uniform(0.01, 0.19)
            m, at = max(1, int(n * part)), rng.randrange(n)
            if kind == 0:
                c = list(w)
                for i in rng.sample(range(n), max(1, m // 6)):
                    c[i] = "changed"
            else:
                c = w[:-m] if kind == 1 else w[:at] + new(m) + w[at:]
            a, b = shingles(" ".join(w)), shingles(" ".join(c))
            if len(a & b) >= 0.8 * len(a | b):
                pairs.append((len(rows), len(rows) + 1))
                rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(c))]
                k += 1
    group = {r.doc_id: r.group for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert len(set(group.values())) >= len(pairs)


def test_keep_one_odd_rows(odd, none):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    assert Counter(r.text for r in got.collect())["a b c"] == 1
    assert simhash.keep_one(none).count() == 0


# --- 3: URL filter ------------------------------------------------------------------------------------------------


def test_url_query_equals_sql(spark, small, duck):
    got, want = url_filter.query(spark, small).toPandas(), duck.execute(url_filter.oracle()).fetchdf()
    assert rows_of(got) == rows_of(want)


def _url_cases():
    html = '<link rel="canonical" href="{}">'
    return [
        (1, "http://a.example.com/en/x", None, "block"),
        (2, "http://x.org/1", html.format("http://a.example.com/en/x"), "block"),  # alias of a blocked url
        (3, "https://x.org/1/?utm_source=a#top", "", "block"),  # another spelling of 2
        (4, "http://y.org/1", html.format("http://www.example.com/en/x"), "allow"),
        (5, "http://y.org/1#z", html.format("http://b.example.com/en/"), "allow"),  # aliases of an allowed and a blocked url
        (6, "http://b.example.com/en/", None, "block"),  # its own rule
        (7, None, "<html>", "allow"),
        (8, "no url", None, "allow"),
        (9, "HTTP://N.NET/es/", "", "block"),
        (9, "HTTP://N.NET/es/", "", "block"),
        (None, "http://z.org", '<meta http-equiv="refresh" content="0; url=//m.net/fr/1">', "block"),
        (11, "://", "", "allow"),
        (12, "http://a.org/x?u=http://b.net/es/1", None, "allow"),  # a url in a query is no alias
        (13, "http://q.org/r?u=http://s.example.com/en/1#f", None, "allow"),
        (14, "http://c.org/in/page", '<link href="../up/./bad" rel=canonical><LINK REL=canonical HREF=mailto:x>', "block"),
        (15, "http://c.org/up/bad/", html.format("https://k.net/fr/z"), "block"),
        (16, "http://d.org/x/y.html?p=1", '<meta content="5;URL=?p=2" http-equiv=refresh>' + html.format("z"), "block"),
        (17, "http://d.org/x/y.html?p=2#a", html.format("#top"), "block"),
        (18, "http://d.org/x/z", html.format("//e.net/es/"), "block"),
        (19, "b.net/x?v=http://f.org/", None, "allow"),
        (20, "http://g.org/net/es/", html.format("http://g.org/" + "a/" * 3000), "allow"),
    ]


def test_url_aliases_and_precedence(spark):
    rows = _url_cases()
    pages = spark.createDataFrame([(i, u, h, "c", 1) for i, u, h, _ in rows], "page_id long, url string, html string, component string, key int")
    got = sorted((str(r.page_id), r.verdict) for r in url_filter.judge_urls(pages).collect())
    assert got == sorted((str(i), v) for i, _, _, v in rows)
    r = {x.page_id: x for x in url_filter.judge_urls(pages).collect()}
    assert (r[9].host, r[9].path, r[9].rule) == ("n.net", "/es/", "net/es/")
    assert (r[7].host, r[7].path, r[7].rule) == ("", "", None)
    extra = spark.createDataFrame([("http://q.org/", "http://a.example.com/en/x"), (None, "x")], "src string, dst string")
    one = spark.createDataFrame([(1, "http://q.org/", None)], "page_id long, url string, html string")
    assert url_filter.judge_urls(one, redirects=extra).first().verdict == "block"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    tie = spark.createDataFrame([(1, "http://t.org/a", None)], "page_id long, url string, html string")
    assert url_filter.judge_urls(tie, rules=(("block", "t.org", "/"), ("allow", "t.org", "/"))).first().verdict == "allow"


def test_url_sql_on_declared_links(spark, tmp_path):
    """The cases with links, through the SQL as well as through Spark."""
    import duckdb

    spark.createDataFrame([r[:3] for r in _url_cases()], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = [tuple(r) for r in url_filter.query(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.execute(url_filter.oracle()).fetchall()))


# --- 4: language ID -----------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, small, docs):
    got = langid.query(spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 20])
def test_codewords_differ(n):
    c = langid.codewords(n)
    assert len(c) == n
    if n > 1:
        apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= c.shape[1] // 4 and min(apart) >= 1


def test_language_odd_rows(spark, odd, none):
    model = langid.train(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    und = Counter((r.lang_pred, r.score) for r in got if r.lang_pred == "und")
    assert und == {("und", 0.0): 5}
    assert langid.predict(none, model).count() == 0
    untaught = langid.train(none)
    assert {r.lang_pred for r in langid.predict(odd, untaught).collect()} == {"und"}
    one = langid.train(spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.predict(odd, one).collect()} == {"und", "xx"}


# --- 5: media -----------------------------------------------------------------------------------------------------


def test_media_round_trip(odd, none):
    import hashlib

    got = media.digest(media.store_texts(odd)).collect()
    for r, src in zip(got, odd.collect(), strict=True):
        raw = (src.text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media.digest(media.store_texts(none)).count() == 0


def test_media_tables(spark):
    size = 64 * 1000 + 5
    content = media.write_media(bytes(range(256)) * (size // 256) + bytes(size % 256))
    rows = [(1, content), (2, None), (3, b""), (4, content[:300]), (5, b"\0\0\0\x10wide\0\0\0\0\0\0\0\0" + content[:100])]
    got = {r.id: r for r in media.describe_media(spark.createDataFrame(rows, "id long, content binary"), "id").collect()}
    track = got[1].tracks[0]
    assert (track.codec, track.handler, track.samples, track.timescale, track.duration) == ("raw ", "soun", 1001, media.TIMESCALE, 1001 * 64)
    frames = [(k.offset + i * k.step, k.length) for k in track.keyframes for i in range(k["count"])]
    assert len(frames) == -(-1001 // media.KEYFRAME_EVERY)
    data = content.index(b"mdat") + 4
    assert frames == [(data + 64 * media.KEYFRAME_EVERY * i, 64) for i in range(len(frames))]
    assert got[2].tracks is None and got[2].error is None
    assert got[3].error and got[4].error and got[5].error


def test_hostile_media(spark):
    """Deep nesting, counts beyond the file and tables that do not fit give an error, little memory and no crash."""
    import struct

    plain = media.write_media(bytes(range(200)) * 5)
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    huge = media.box(b"moov", media.box(b"trak", media.full(b"stsz", struct.pack(">II", 64, 0xFFFFFFFF))))
    times = plain.replace(b"stts" + bytes(4) + struct.pack(">I", 1), b"stts" + bytes(4) + struct.pack(">I", 0xFFFFFFFF))
    wide = plain.replace(struct.pack(">III", 1, 16, 64), struct.pack(">III", 1, 0xFFFFFFFF, 0xFFFFFFFF))
    chunks = plain.replace(b"stco" + bytes(4) + struct.pack(">I", 1), b"stco" + bytes(4) + struct.pack(">I", 7))
    bad = [deep, huge, times, wide, chunks, plain[:-70], plain + b"x", media.box(b"moov", media.box(b"trak", media.box(b"mdhd")), media.box(b"trak", media.box(b"mdhd", b"1")))]
    bad += [plain[:i] + bytes([255] * 4) + plain[i + 4 :] for i in range(0, plain.index(b"mdat"), 3)]
    got = {r.id: r for r in media.describe_media(spark.createDataFrame(list(enumerate([plain, *bad])), "id int, content binary"), "id").collect()}
    assert len(got) == len(bad) + 1 and got[0].error is None and got[0].tracks[0].samples == 16
    assert all(got[i].error for i in (1, 2, 3, 5, 6, 7, 8))
    small = b"".join((bytes([0, 0, 0, 0]), bytes(3), bytes([4]), struct.pack(">I", 3), bytes([0x12, 0x30])))
    t = media.Track()
    t.take(b"stz2", memoryview(small), 0, len(small))
    assert t.sizes.tolist() == [1, 2, 3] and t.before(np.array([3])).tolist() == [6]


# --- 6 and 9: tokens ----------------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    enc = tokens.Encoder(tokens.vocabulary_path())
    rng = random.Random(1)
    parts = ["a", "B", "'s", "'", "0", "9", " ", "\n", "é", "é", "̸", "=", "!", "<|endoftext|>", "<|EndOfText|>", "ß", "İ", "中", "“", "\x00", "Σ", "_", "it's", "..", "K", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    ids, o = enc.block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), None)
    assert [ids[i:j].tolist() for i, j in zip(o[:-1], o[1:], strict=True)] == [x.tolist() for x in enc.whole(texts)]


def test_token_files_round_trip(spark, odd, none, tmp_path):
    enc = tokens.Encoder(tokens.vocabulary_path())
    path = str(tmp_path / "files")
    tokens.write_token_files(odd, path, tokens.vocabulary_path())
    got = tokens.read_token_files(spark, path).orderBy("start").collect()
    rows = odd.collect()
    want = Counter((r.doc_id, zlib.crc32(np.append(enc.whole([r.text or ""])[0], 2).astype("<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert tokens.read_document(spark, path, 5)[0].tolist() == [*enc.whole([rows[5].text])[0], 2]
    assert len(tokens.read_document(spark, path, 6)) == 3 and tokens.read_document(spark, path, 99) == []
    tokens.write_token_files(none, str(tmp_path / "none"), tokens.vocabulary_path())
    assert tokens.read_token_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_separator_scan_stitches_blocks(spark, size):
    rng = random.Random(size)
    stream, rows = [], []
    for part in range(4):
        ids = [rng.choice([9, 9, 9, 5, 6]) for _ in range(rng.choice([0, 7, 40]))]
        stream += ids
        rows += [(part, b, bytearray(np.array(ids[k : k + size], "<u2").tobytes())) for b, k in enumerate(range(0, len(ids), size))]
    got = tokens.separator_scan(spark.createDataFrame(rows, "part int, block int, ids binary"), end=5).collect()
    want, at = [], 0
    for i, x in enumerate(stream):
        if x == 5:
            want.append((at, i + 1 - at))
            at = i + 1
    if at < len(stream):
        want.append((at, len(stream) - at))
    assert sorted((r.start, r.n_tokens) for r in got) == want
    assert sorted(r.doc for r in got) == list(range(len(want)))


def test_flat_files_of_odd_rows(spark, odd, none, tmp_path):
    """Nulls first, then ids in order, equal ids next to each other; a separator that a text encodes to is an error."""
    tokens.write_flat_files(odd, str(tmp_path / "odd"), tokens.vocabulary_path(), tokens.SEPARATOR, tokens=1000)
    got = sorted(tokens.separator_scan(spark.read.parquet(str(tmp_path / "odd")), tokens.SEPARATOR).collect(), key=lambda r: r.doc)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda x: (x is not None, x or 0))
    tokens.write_flat_files(none, str(tmp_path / "none"), tokens.vocabulary_path(), tokens.SEPARATOR)
    assert tokens.separator_scan(spark.read.schema(tokens._FLAT).parquet(str(tmp_path / "none")), tokens.SEPARATOR).count() == 0
    bad = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    with pytest.raises(Exception, match="encodes to the separator"):
        tokens.write_flat_files(bad, str(tmp_path / "bad"), tokens.vocabulary_path(), 49407)


def test_separator_query_counts_every_document(spark, small, texts):
    got = tokens.query_separator_scan(spark, small).collect()
    enc = tokens.Encoder(tokens.vocabulary_path())
    assert sorted(r.n_tokens for r in got) == sorted(len(x) + 1 for x in enc.whole(list(texts.values())))
    assert tokens.separator_scan(spark.createDataFrame([], "part int, block int, ids binary")).count() == 0


# --- 7: decontamination -------------------------------------------------------------------------------------------


def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(-1, 6, rng.integers(0, 90))
        assert decontaminate.lcs_length(a, b) == slow(a.tolist(), b.tolist())


def test_benchmark_passages_are_found(spark, small, docs):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = bench.collect()
    rng = random.Random(6)
    clean = [r for r in docs.collect() if not any(b.text in r.text for b in items)][:60]
    rows, want = [], set()
    for k, r in enumerate(clean):
        t = r.text
        if k % 3 == 0:
            b = items[k % len(items)]
            w = b.text.split()
            if k % 6 == 0 and len(w) > 20:  # a paraphrase: a few words changed
                for _ in range(len(w) // 12):
                    w[rng.randrange(len(w) * 3 // 4)] = "otherwise"
            t = t[: len(t) // 2] + " " + " ".join(w) + " " + t[len(t) // 2 :]
            want.add((r.doc_id, b.item_id))
        rows.append((r.doc_id, t, 1.0))
    got = decontaminate.contaminated(spark.createDataFrame([*rows, (None, None, 1.0), (-1, "", 1.0)], "doc_id long, text string, cosine double"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown"), (2, None), (3, ""), (4, "..."), (1, "quick brown")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(odd, bench).collect()] == [1]
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    kept = decontaminate.keep_uncontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


# --- 8: toxicity --------------------------------------------------------------------------------------------------


def _toxic_corpus(n: int = 500):
    rng = random.Random(8)
    words = ["".join(rng.choice(["ba", "re", "ti", "on", "sel"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = rng.choices(words, k=rng.randrange(5, 120))
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["grumblo", "snarko" + rng.choice(words)])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


def test_toxic_documents_are_found(spark):
    rows = _toxic_corpus(900)
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 700], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    late = [(got[i], y) for i, _, y in rows if i >= 700]
    assert sum(p for p, y in late if y) >= 0.8 * sum(y for _, y in late)
    assert sum(p for p, y in late if not y) <= 0.1 * sum(not y for _, y in late)


def _some_network(text: list[bytes], seed: int = 1):
    x = toxicity.inputs(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
    net, rng = toxicity.Network(seed), np.random.default_rng(seed)
    net.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    net.counts = toxicity.Counts(rng.standard_normal(net.counts.word.shape), rng.standard_normal(net.counts.gram.shape))
    return x, net


def test_gradients():
    """Analytic gradients of every parameter against differences, where they are largest and elsewhere."""
    x, net = _some_network([b"grumblo tion on re", b"ba re on ti sel on", b"x"])
    start, of = x.windows()
    ids, y, share = x.window_ids(start, of), np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z = net.forward(net.gates(net.embed(x)), ids).astype(np.float64)
        return float((np.logaddexp(0, z) - y * z).sum())

    grad = net.backward(x, net.embed(x), ids, y, share)
    assert set(grad) == set(net.p)
    for name, d in grad.items():
        flat, d = net.p[name].reshape(-1), d.reshape(-1)
        for k in {int(np.abs(d).argmax()), len(flat) // 2, 0}:
            keep, step = flat[k], 3e-3
            flat[k] = keep + step
            up = loss()
            flat[k] = keep - step
            down = loss()
            flat[k] = keep
            assert d[k] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3), (name, k)


def test_scores_equal_a_window_by_window_loop():
    """Scores of whole texts against one plain recurrence for each window and character."""
    words = [f"w{i * i % 37}" for i in range(70)]
    texts = [" ".join(words).encode(), b"one two", b"", "Idiot É é".encode()]
    x, net = _some_network(texts, 3)
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    net.scale, net.shift = 0.7, -0.2
    p, sig = {k: v.astype(np.float64) for k, v in net.p.items()}, lambda z: 1 / (1 + np.exp(-z))

    def word_input(w: int):
        a, z = x.char_at[w], x.char_at[w + 1]
        seen = [np.append(p["byte"][c], net.counts.gram[g]) for c, g in zip(x.chars[a:z], x.grams[a:z])]
        blank = np.zeros(toxicity.BYTE + 1)
        high = [np.tanh(np.concatenate([seen[i - 1] if i else blank, seen[i], seen[i + 1] if i + 1 < len(seen) else blank]) @ p["K"] + p["k"]) for i in range(len(seen))]
        return np.concatenate([net.counts.word[x.rows[w]], p["word"][x.rows[w] % toxicity.WORD_ROWS], np.max(high, axis=0)])

    def run(inputs, d):
        h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for v in inputs:
            i, r = v @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            z, reset = sig(i[:n] + r[:n]), sig(i[n : 2 * n] + r[n : 2 * n])
            h = (1 - z) * np.tanh(i[2 * n :] + reset * r[2 * n :]) + z * h
            out.append(h)
        return out

    want = []
    for t in range(len(texts)):
        ids, best = x.ids[x.first[t] : x.first[t + 1]].tolist(), -np.inf
        at = 0
        while True:
            window = ids[at : at + toxicity.WINDOW]
            pad = toxicity.WINDOW - len(window)
            inputs = [word_input(w) for w in window] + [np.zeros(toxicity.EMBED + toxicity.FILTERS)] * pad
            states = [np.concatenate(s) for s in zip(run(inputs, "f"), run(inputs[::-1], "b")[::-1])]
            e = np.array([np.tanh(s @ p["A"]) @ p["v"] for s in states])
            if window:
                e[len(window) :] = -np.inf
            e = np.exp(e - e.max())
            best = max(best, (e / e.sum()) @ np.array(states) @ p["w"] + p["o"][0])
            at += toxicity.STRIDE
            if at + toxicity.WINDOW - toxicity.STRIDE >= len(ids):
                break
        want.append(sig(net.scale * best + net.shift))
    data = np.frombuffer(b"".join(texts), np.uint8)
    assert net.scores(data, np.cumsum([0, *map(len, texts)])) == pytest.approx(np.array(want), abs=2e-4)


def area(score, y) -> float:
    _, inv, many = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(many) - (many - 1) / 2)[inv]
    n = y.sum()
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)))


def test_held_out_toxicity_beats_single_words(spark):
    """On the given labels, the rows that never train: above the largest log-odds of a text's words."""
    for sf, least in (("/root/testdata/sf0.01", 0.7), ("/root/testdata/sf0.1", 0.94)):
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id")
        late = toxicity.held_out("doc_id", 4)
        scorer = toxicity.train(docs.where(~late), labels.where(~late))
        rows = docs.join(labels, "doc_id").withColumn("late", late).select("doc_id", "text", "toxic", "late").collect()
        bag = lambda r: set(re.findall(r"[^\W_]+", (r.text or "").lower()))
        seen, hit = Counter(), Counter()
        learn, test = [r for r in rows if not r.late], [r for r in rows if r.late]
        for r in learn:
            seen.update(bag(r))
            hit.update(bag(r) if r.toxic else ())
        share = sum(r.toxic for r in learn) / len(learn)
        odds = lambda w: math.log((hit[w] + share) / (seen[w] - hit[w] + 1 - share))
        raw = [(r.text or "").encode() for r in test]
        score = np.concatenate([scorer.scores(np.frombuffer(b"".join(raw[k : k + 100]), np.uint8), np.cumsum([0, *map(len, raw[k : k + 100])])) for k in range(0, len(raw), 100)])
        y = np.array([r.toxic for r in test])
        got, plain = area(score, y), area(np.array([max((odds(w) for w in bag(r) if w in seen), default=-9.0) for r in test]), y)
        print(sf, "area", round(got, 4), "words", round(plain, 4), "recall", ((score >= 0.3) & (y == 1)).sum() / y.sum(), "false", ((score >= 0.3) & (y == 0)).sum() / (y == 0).sum())
        assert got > least  # of 14 toxic texts of the smaller, five have no toxic word: its area is chance to 0.1 or so
        if len(y) > 500:
            assert got > plain


def test_toxicity_odd_rows(spark, odd, none):
    rows = _toxic_corpus(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in rows), (None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(none, model).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd, toxicity.train(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_windows_cover_every_word():
    words = [b" ".join(b"w%d" % i for i in range(n)) for n in (0, 1, 23, 24, 25, 36, 37, 100)]
    x = toxicity.inputs(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    start, of = x.windows()
    for t, (a, z) in enumerate(zip(x.first[:-1], x.first[1:], strict=True)):
        met = set()
        for s in start[of == t]:
            met |= set(range(s, min(s + toxicity.WINDOW, z)))
        assert met == set(range(a, z)) and (of == t).any()


# --- 10: mixing ---------------------------------------------------------------------------------------------------


def test_targets_are_filled():
    assert mixing.targets({"a": 10, "b": 10, "c": 10}) == pytest.approx({"a": 18.75, "b": 7.5, "c": 3.75})
    got = mixing.targets({"a": 1, "b": 100, None: 3, "z": 50})
    assert got["a"] == 3 and sum(got.values()) == pytest.approx(154) and all(got[k] <= 3 * n for k, n in {"b": 100, None: 3, "z": 50}.items())
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 5})["a"] == 0


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(p.tolist()) == list(range(n))


def test_mix_is_near_its_targets_and_repeats(spark, small, docs):
    got = mixing.query(spark, small).collect()
    assert sorted(got) == sorted(mixing.query(spark, small).collect())
    of = {r.doc_id: r.source for r in docs.collect()}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t + 2 * mixing.BLOCK_WORDS


def test_mix_equals_a_slot_by_slot_loop(spark):
    """`taken` of every document, recomputed by one loop over shards and slots."""
    rng, block, slots, seed = random.Random(10), 8, 16, 5
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", None]), "_p") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string")
    shown, _ = mixing.mix(docs, seed, block, slots)
    got = {r.doc_id: r for r in shown.collect()}
    names = ["a", "b", None]
    total = {s: sum(len(t.split()) for _, t, x, _ in rows if x == s) for s in names}
    goal = mixing.targets(total)
    blocks_of = np.array([-(-total[s] // block) for s in names])
    want = np.array([goal[s] * n / total[s] for s, n in zip(names, blocks_of)])
    n = int(round(want.sum()))
    wanted = mixing.whole_slots(want, n)
    assert wanted.sum() == n and (abs(wanted - want) < 1).all()
    drawn, order = np.zeros(3, np.int64), []
    for shard in range(-(-n // slots)):
        k = np.random.default_rng([seed, shard]).multinomial(min(slots, n - shard * slots), want / want.sum())
        order += [(s, drawn[s] + i) for s in range(3) for i in range(k[s])]
        drawn += k
    uses = Counter()
    src, j = mixing.reassigned(np.array([s for s, _ in order]), np.array([x for _, x in order]), drawn, wanted, seed)
    assert np.bincount(src, minlength=3).tolist() == wanted.tolist() and len(set(zip(src.tolist(), j.tolist()))) == n
    for s, x in zip(src.tolist(), j.tolist()):
        with np.errstate(over="ignore"):
            key = mixing.mix64(np.uint64(seed) + mixing.mix64(np.array([(s << 32) + x // blocks_of[s]], np.uint64)))
        uses[s, int(mixing.permuted(np.array([x % blocks_of[s]]), blocks_of[s : s + 1], key)[0])] += 1
    # the places of the documents are those that the query gives them
    at = {r.doc_id: (r.src, r.at) for r in mixing.laid_out(shown.join(docs.select("doc_id", "source"), "doc_id").where("size > 0").select("doc_id", "tag", F.when(F.col("source") == "a", 0).when(F.col("source") == "b", 1).otherwise(2).cast("long").alias("src"), "size"), block).collect()}
    for i, t, _, _ in rows:
        size = len(t.split())
        taken = sum(uses[at[i][0], (at[i][1] + w) // block] for w in range(size)) if size else 0
        assert (got[i].size, got[i].taken) == (size, taken)
    assert sum(r.taken for r in got.values()) == sum(len(r.text.split()) for r in mixing.mixed_documents(docs, seed).collect()) or block != mixing.BLOCK_WORDS


def test_mix_draws_shards_from_a_multinomial():
    """Before the correction a shard's counts vary like a multinomial's, and the correction moves few slots."""
    share, n = np.array([0.5, 0.3, 0.2]), 4096
    k = np.array([np.random.default_rng([1, i]).multinomial(n, share) for i in range(400)])
    assert abs(k[:, 0].std() / math.sqrt(n * 0.25) - 1) < 0.15
    drawn, wanted = k.sum(0), mixing.whole_slots(share * 400 * n, 400 * n)
    src = np.repeat(np.arange(3), drawn)
    j = np.concatenate([np.arange(d) for d in drawn])
    to, _ = mixing.reassigned(src, j, drawn, wanted, 1)
    assert (to != src).sum() == np.maximum(drawn - wanted, 0).sum() and np.bincount(to).tolist() == wanted.tolist()


def test_mixed_documents_hold_the_taken_words(spark, docs, odd, none):
    shown = mixing.mixed_documents(docs).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    said = {r.doc_id: r.taken for r in mixing.mix(docs)[0].collect()}
    assert {r.doc_id: r.n for r in shown.collect()} == {i: n for i, n in said.items() if n}
    assert mixing.mix(odd)[0].count() == odd.count() and mixing.mix(none)[0].count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert sum(r.taken for r in mixing.mix(odd)[0].collect()) == sum(len(r.text.split()) for r in mixing.mixed_documents(odd).collect())


# --- all ----------------------------------------------------------------------------------------------------------


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, small, docs):
    import corpus_pipeline

    d = docs
    for name, stage in corpus_pipeline.STAGES:
        from wavelake.llm.common import materialise

        nxt = materialise(stage(spark, d, small), f"test-{name}")
        if name != "token_files":
            assert nxt.columns == docs.columns
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert nxt.exceptAll(d).isEmpty()
        if name == "decontamination":
            bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert not any(b in r.text for r in nxt.collect() for b in bench)
        d = nxt
    rows = d.orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_copies_of_template_texts_are_found(spark):
    """Keys under which hundreds of texts of one template meet: all pairs of a similarity of 0.8 are linked."""
    rng, template = random.Random(5), [f"t{i}" for i in range(160)]
    texts = []
    for i in range(600):
        t = [*template, *(f"u{i}x{k}" for k in range(40))]
        copy = list(t)
        for k in range(rng.randrange(1, 4)):
            copy[rng.randrange(200)] = f"c{i}x{k}"
        texts += [" ".join(t), " ".join(copy)]
    sets = [set(shingles(t)) for t in texts]
    # texts of two pairs have 156 shingles in common of 236 or more
    true = [(i, i + 1) for i in range(0, len(sets), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(true) > 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.group for r in simhash.similar_groups(docs).collect()}
    lost = [p for p in true if group[p[0]] != group[p[1]]]
    assert not lost
    assert len(set(group.values())) == len(texts) - len(true)


def test_repeated_lines_do_not_move_wide_fingerprints(spark):
    """Near copies that differ in how often a line repeats: their sets of shingles are nearly equal."""
    rng, texts = random.Random(6), []
    for i in range(20):
        words, line = [f"w{i}x{k}" for k in range(200)], [f"l{i}x{k}" for k in range(10)]
        texts += [" ".join(words + line * n) for n in (1, rng.choice((20, 60)))]
    sets = [set(shingles(t)) for t in texts]
    assert all(len(sets[i] & sets[i + 1]) >= 0.9 * len(sets[i] | sets[i + 1]) for i in range(0, 40, 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.group for r in simhash.similar_groups(docs).collect()}
    assert sum(group[i] != group[i + 1] for i in range(0, 40, 2)) == 0 and len(set(group.values())) == 20
    long = " ".join(["a b c d e"] * 60_000 + ["f"])  # over several pieces
    data = np.frombuffer(f"{long}{long} g".encode(), np.uint8)
    words = simhash.Words(data, np.array([0, len(long), len(data)]))
    got = [(d, int(x)) for doc, h in simhash._distinct_shingles(*words.joined(), words.first, 5) for d, x in zip(doc.tolist(), h, strict=True)]
    assert len(got) == len(set(got)) and Counter(d for d, _ in got) == {0: len(set(shingles(long))), 1: len(set(shingles(f"{long} g")))}


def test_candidate_edges_of_several_files_in_one_task(spark, tmp_path):
    """One batch with ids of several partitions: edges name the ids that are given."""
    rng = np.random.default_rng(3)
    rows = [((p << 33) + k, rng.bytes(simhash._WIDE)) for p in range(6) for k in range(3)]
    rows += [((7 << 33) + n, wide) for n, (_, wide) in enumerate(rows)]
    distinct = spark.createDataFrame(rows, "id long, wide binary").coalesce(1)
    want = {((7 << 33) + n, i) for n, (i, _) in enumerate(rows[:18])}
    assert {(r.src, r.dst) for r in simhash.candidate_edges(distinct, 4).collect()} == want


def test_short_items_are_found_at_any_cosine(spark, small, docs):
    """Items of 2 to 19 words in documents at random, verbatim and (from 8 words) with a sixth of the words replaced."""
    rng = random.Random(8)
    hosts = [r.text for r in docs.where("text is not null").orderBy("doc_id").collect()]
    source = [re.findall(r"[^\W_]+", r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items, rows = [], []
    for n in (2, 7, 10, 17):
        for k in range(40):
            w = rng.choice([x for x in source if len(x) >= n])
            at = rng.randrange(len(w) - n + 1)
            items.append((100 * n + k, " ".join(w[at : at + n])))
            words = list(w[at : at + n])
            for j in rng.sample(range(n), n // 6 if n >= 8 and k % 2 else 0):
                words[j] = "replacedword"
            host = rng.choice(hosts).split()
            cut = rng.randrange(len(host) + 1)
            rows.append((100 * n + k, " ".join(host[:cut] + words + host[cut:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    lost = Counter(i // 100 for i, _ in items if (i, i) not in got)
    assert not lost


def test_separator_scan_names_documents_in_order(spark, tmp_path):
    """Each document's id and count in ascending order of the ids, and a text that spells a special token is one."""
    texts = [(i * 7 % 50, "one two " * (i % 5) + ("hello <|endoftext|> world" if i % 3 == 0 else "")) for i in range(50)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tokens.query_separator_scan(spark, str(tmp_path)).collect(), key=lambda r: r.doc)
    sizes = [len(x) + 1 for x in tokens.Encoder(tokens.vocabulary_path()).whole([t for _, t in sorted(texts)])]
    assert [r.doc_id for r in got] == list(range(50)) and [r.doc for r in got] == list(range(50))
    assert [r.n_tokens for r in got] == sizes and [r.start for r in got] == np.cumsum([0, *sizes])[:-1].tolist()
    flat = spark.createDataFrame([(i, t) for i, t in sorted(texts)], "doc_id long, text string")
    tokens.write_flat_files(flat, str(tmp_path / "flat"), tokens.vocabulary_path(), tokens.SEPARATOR, tokens=7)
    small = tokens.separator_scan(spark.read.parquet(str(tmp_path / "flat")), tokens.SEPARATOR).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in small) == [(r.doc_id, r.start, r.n_tokens) for r in got]


def test_lm_query_uses_trigrams(spark, small, docs):
    """The registered query's held-out score is that of order 3, above that of bigrams."""
    held = lambda df: df.where("held_out").agg(F.sum("score")).first()[0]
    got = held(lmscore.query(spark, small))
    assert got == pytest.approx(held(lmscore.score(docs, order=3))) and got > held(lmscore.score(docs, order=2))
