"""What a step costs, counted or set against the plain way: the results must be the same."""

import random
import time

import numpy as np

from wavelake.llm import decontaminate, simhash, tokens

# --- decontamination ----------------------------------------------------------------------------------------------


def test_common_share_is_a_lookup_by_term():
    rng = np.random.default_rng(3)
    terms, windows, rows = 4000, 300, 2000
    own = [np.unique(rng.integers(0, terms, 32)) for _ in range(windows)]
    part = [rng.random(len(w)).astype(np.float32) for w in own]
    near = np.sort(rng.integers(-1, terms, (rows, 32)), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[: rows // 2, :8] = own[0][:8]
    row = np.concatenate([np.sort(rng.choice(rows, 800, replace=False)) for _ in range(windows)])
    window = np.repeat(np.arange(windows), 800)
    began = time.process_time()
    got = decontaminate.common_share(near, row, window, (own, part), terms)
    took = time.process_time() - began

    began = time.process_time()
    cells = np.concatenate([i * terms + w for i, w in enumerate(own)])
    key = window[:, None] * terms + near[row]
    at = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
    want = np.where((cells[at] == key) & (near[row] >= 0), np.concatenate(part)[at], 0).sum(1, dtype=np.float32)
    searched = time.process_time() - began
    assert (got == want).all() and (got > 0).any() and (got == 0).any()
    assert took < searched / 2
    assert len(decontaminate.common_share(near, row[:0], window[:0], (own, part), terms)) == 0


# --- tokens -------------------------------------------------------------------------------------------------------


def test_pieces_of_late_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 100)
    enc = tokens.Encoder(tokens.vocabulary_path())
    encoded, met = enc.encoded, []
    enc.encoded = lambda pieces: met.append(len(pieces)) or encoded(pieces)
    letters = "abcdefghij"
    word = lambda i: "w" + "".join(letters[int(d)] for d in str(i))
    often = [word(i) for i in range(80)] + ["été", "l'", "0", "7", "..", "ü0"]
    for k in range(4):
        texts = [" ".join(often), " ".join(word(1000 + 60 * k + i) for i in range(60)), ""]
        raw = [t.encode() for t in texts]
        ids, o = enc.block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), None)
        assert [ids[i:j].tolist() for i, j in zip(o[:-1], o[1:], strict=True)] == [x.tolist() for x in enc.whole(texts)]
        assert len(enc.known.names) == 100
    assert met == [146, 60, 60, 60]


def test_plain_pieces_need_no_marks(monkeypatch):
    """Only what is no plain word goes through the whole tokenizer."""
    enc = tokens.Encoder(tokens.vocabulary_path())
    whole, given = enc.whole, []
    monkeypatch.setattr(enc, "whole", lambda texts: given.extend(texts) or whole(texts))
    text = "Plain words, 2 signs (of 10)! l'été"
    ids, _ = enc.block(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), None)
    assert given == ["l'été"] and ids.tolist() == whole([text])[0].tolist()
    monkeypatch.setattr(enc, "by_ends", lambda names: None)  # a model whose ids do not tell where words end
    enc.known = tokens.Pieces.none()
    again, _ = enc.block(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), None)
    assert again.tolist() == ids.tolist()


# --- near copies --------------------------------------------------------------------------------------------------


def test_dense_groups_are_linked_in_rounds(spark, monkeypatch):
    """Pairs of two halves of a group, whose search tree holds too few links, are joined until the halves are one."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(120), 1):
            words[at] = f"x{i}.{at}"
        rows.append((i, " ".join(words)))
    sets = simhash._shingle_sets(spark.createDataFrame(rows, "id long, text string"), 5)
    alone = simhash.materialise(sets.selectExpr("id", "id as component", "shingles"), "alone")
    every = {tuple(r) for r in simhash.rare_pairs(alone, 0.8).collect()}
    parts = [{tuple(r) for r in simhash.rare_pairs(alone, 0.8, lots=lots).collect()} for lots in simhash.ROUNDS]
    assert len(every) > 2000 and set.union(*parts) == every and sum(map(len, parts)) == len(every)

    found, rare = [], simhash.rare_pairs

    def counted(crowd, *a, **k):
        out = rare(crowd, *a, **k)
        found.append(out.count())
        return out

    monkeypatch.setattr(simhash, "rare_pairs", counted)
    monkeypatch.setattr(simhash, "candidate_edges", lambda distinct, shards: distinct.selectExpr("id as src", "id as dst"))
    groups = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.group for r in groups}) == 1 and len(groups) == 120
    assert sum(found) < len(every) / 4
