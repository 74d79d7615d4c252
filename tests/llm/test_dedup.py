"""Exact, substring, suffix and near-duplicate operators against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestry.llm import exact_dedup, simhash, substring_dedup, suffix_dedup, tiles
from attestry.llm.suffix_repeats import array, intervals

#: Columns with names that the operators use inside, to show that they do not clash.
SCHEMA = "doc_id long, text string, row string, shard string, whole string, k1 long, fp string, name string, key string, spans string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 3, 7, *["x"] * 4) for r in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- exact ---------------------------------------------------------------------------------------

EXACT = [(5, "a  b"), (3, "a b"), (9, "a\t\nb"), (4, None), (2, ""), (7, " "), (8, " "), (1, "\x0b\x0c"), (6, "A b"), (10, "x" * 200_000), (11, "x" * 200_000), (12, "a\u00a0b"), (None, "a b"), (3, "a b")]


def test_exact_matches_brute_force(spark):
    got = exact_dedup.find(table(spark, EXACT)).collect()
    flat = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, (_, t) in enumerate(EXACT)}
    want = []
    for i, (doc, _) in enumerate(EXACT):
        group = [EXACT[j][0] for j in flat if flat[j] == flat[i]]
        want.append((doc, min(x for x in group if x is not None), len(group), hashlib.sha256(flat[i].encode()).hexdigest()))
    key = str
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({f for f in flat.values()}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_columns_and_one_row_of_equal_rows(spark):
    got = exact_dedup.dedup(table(spark, EXACT))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 6, 10, 12]


def test_exact_of_nothing(spark):
    assert exact_dedup.find(table(spark, [])).count() == exact_dedup.dedup(table(spark, [])).count() == 0


def test_exact_has_no_python_and_a_combining_tree(spark):
    plan = exact_dedup.find(table(spark, EXACT))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("fan, rounds", [(2, 1), (2, 4), (3, 2), (8, 2)])
def test_exact_is_the_same_whatever_the_tree(spark, fan, rounds):
    want = sorted(map(str, exact_dedup.find(table(spark, EXACT)).collect()))
    assert sorted(map(str, exact_dedup.find(table(spark, EXACT).repartition(3), fan=fan, rounds=rounds).collect())) == want


def test_exact_runs_are_exchanged_by_partition_and_merged_in_order(spark):
    """Each round deals by partition number, sorts there and aggregates what is sorted, with no exchange between."""
    rows = spark.createDataFrame([(i, i, hashlib.sha256(str(i % 40).encode()).hexdigest(), i % 40) for i in range(200)], "doc_id long, row long, text_sha256 string, check long")
    merged = exact_dedup.merge_runs(rows, fan=2, rounds=3)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(part") == 4 == plan.count("Exchange") and "HashAggregate" not in plan
    assert sorted((r.keep_id, r.group_size) for r in merged.collect()) == [(i, 5) for i in range(40)]


def test_exact_stops_where_texts_share_a_digest(spark):
    rows = spark.createDataFrame([(1, 10, "same", 1), (2, 11, "same", 2)], "doc_id long, row long, text_sha256 string, check long")
    with pytest.raises(Exception, match="share a SHA-256 digest"):
        exact_dedup.merge_runs(rows).collect()


# --- substrings of words -------------------------------------------------------------------------


def brute_words(rows, window):
    told = [words_of(t) for _, t in rows]
    seen = {}
    for r, w in enumerate(told):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((r, i))
    gone = {(r, i + j) for at in seen.values() if len(at) > 1 for r, i in at for j in range(window)}
    return [(doc, len(w), sum((r, i) in gone for i in range(len(w))), " ".join(x for i, x in enumerate(w) if (r, i) not in gone)) for r, ((doc, _), w) in enumerate(zip(rows, told))]


def word_corpus(seed, vocabulary, n=60):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 14))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.3 else "\t ".join(rng.choice(vocabulary) + rng.choice(["", str(i)]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice([" ", "\n", "  \x0b"]).join(parts)))
    return [*rows, (900, None), (901, ""), (902, "\n"), rows[3], rows[3], (903, "a " * 300), (904, "é ß " * 9)]


@pytest.mark.parametrize("seed, vocabulary, bits", [(1, list("abcdefgh"), 26), (2, list("ab"), 18)])
def test_substring_matches_brute_force(spark, seed, vocabulary, bits):
    rows = word_corpus(seed, vocabulary)
    got = substring_dedup.remove(table(spark, rows), window=6, gram=2, bits=bits).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows, 6))


def test_substring_at_the_contract_length(spark):
    shared = " ".join(f"w{i}" for i in range(35))
    rows = [(1, f"one {shared} two"), (2, f"three {shared} four"), (3, " ".join(f"w{i}" for i in range(34))), (4, "x " * 40_000)]
    got = substring_dedup.remove(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows, 35))


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_names_of_words_and_windows_do_not_cancel_out(spark):
    """Strings that every polynomial modulo a power of two takes for equal."""
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    told = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join([*told[:20], one, *told[20:]])), (2, " ".join([*told[:20], other, *told[20:]]))]
    rows += [(3, " ".join("xy"[c == "a"] for c in one)), (4, " ".join("xy"[c == "b"] for c in one))]
    got = substring_dedup.remove(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows, 35))
    pair = [(1, one), (2, other), (3, "q" + one[:900]), (4, other[:900] + "q")]
    got = suffix_dedup.remove(table(spark, pair)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(brute_bytes(pair, 400))


def test_words_whose_summed_hashes_agree_are_different_words(spark):
    """Two words of 64 letters made so that sums over hashes of byte and place are equal, and the same with white space moved."""
    one, other = "artepznmumdkoybhrqsqswzoxhscuqazzrkspuqfogaoghbisltkwaxtseknoylm", "remwkkryiwnllxxxmyslzhdxuqvpbpdjgvwdwqmzwrtzljlrlvsxkdpzvkmoczpt"
    told = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join([*told[:20], one, *told[20:]])), (2, " ".join([*told[:20], other, *told[20:]]))]
    got = substring_dedup.remove(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0)]
    rows += [(3, "\t \n".join([*told[:20], one, *told[20:]]) + "\n"), (4, "x" + " ".join(told[:36])), (5, " " + "\x0b".join(told[1:37]))]
    got = substring_dedup.remove(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows, 35))


def test_anchors_beyond_the_broadcast_are_joined(spark):
    rows = word_corpus(5, list("abcdefgh"))
    got = substring_dedup.remove(table(spark, rows), window=6, gram=2, broadcast=0).collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows, 6))
    rows = byte_corpus(6, "abcdefghij é")
    for most in (10_000, 2):
        got = suffix_dedup.remove(table(spark, rows), length=12, gram=4, most=most, broadcast=0).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(brute_bytes(rows, 12))


def test_substring_of_nothing(spark):
    assert substring_dedup.remove(table(spark, [])).count() == 0


# --- substrings of bytes -------------------------------------------------------------------------


def brute_bytes(rows, length):
    told = [(t or "").encode() for _, t in rows]
    seen = {}
    for r, b in enumerate(told):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((r, i))
    gone = [set() for _ in told]
    for at in seen.values():
        if len(at) > 1:
            for r, i in at:
                gone[r].update(range(i, i + length))
    out = []
    for (doc, _), b, g in zip(rows, told, gone):
        runs = sum(1 for i in g if i - 1 not in g)
        out.append((doc, len(b), len(g), runs, bytes(x for i, x in enumerate(b) if i not in g)))
    return out


def byte_corpus(seed, letters, n=50):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(10, 30))) for _ in range(5)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 5)))) for i in range(n)]
    return [*rows, (900, None), (901, ""), rows[2], (902, "z" * 500), (903, "éß" * 30)]


@pytest.mark.parametrize("seed, letters, most", [(1, "abcdefghij é", 10_000), (2, "ab", 10_000), (3, "ab", 2)])
def test_suffix_matches_brute_force(spark, seed, letters, most):
    rows = byte_corpus(seed, letters)
    got = suffix_dedup.remove(table(spark, rows), length=12, gram=4, most=most, bits=20).collect()
    mine = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got]
    assert sorted(mine) == sorted(brute_bytes(rows, 12))


def test_suffix_at_the_contract_length(spark):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
    rows = [(1, f"1{shared}2"), (2, f"3{shared}4"), (3, shared[:399]), (4, "q" * 3000), (5, f"5{shared}{shared}6")]
    got = suffix_dedup.remove(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(brute_bytes(rows, 400))


def test_every_repeat_comes_from_an_interval(spark, monkeypatch):
    """Without the interval trees nothing is removed: no repeat is told by names alone."""
    monkeypatch.setattr(suffix_dedup, "_compared", lambda held, length: held.sparkSession.createDataFrame([], suffix_dedup.FOUND))
    rows = byte_corpus(1, "abcdefghij é")
    assert {r.n_removed for r in suffix_dedup.remove(table(spark, rows), length=12, gram=4).collect()} == {0}


def test_a_crowded_anchor_is_split_by_longer_prefixes(spark):
    """One passage of nearly the length in many different surroundings, and a repeat among them."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = word(390)
    rows = [(i, word(300) + passage + word(300)) for i in range(60)]
    rows += [(100 + i, word(20) + rows[i][1][150:620] + word(20)) for i in range(5)]
    for most in (10_000, 8):
        got = suffix_dedup.remove(table(spark, rows), most=most).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(brute_bytes(rows, 400))


def test_suffix_of_nothing(spark):
    assert suffix_dedup.remove(table(spark, [])).count() == 0


def test_intervals_are_the_common_prefix_tree():
    strings = [b"banana", b"anana", b"nana", b"ana", b"na", b"a", b"ana"]
    order, shared = array(strings)
    told = [strings[i] for i in order]
    assert told == sorted(strings)
    for length, first, last in intervals(shared.tolist()):
        part = told[first : last + 1]
        prefix = part[0][:length]
        assert all(s.startswith(prefix) for s in part)
        inside = [s for s in told if s.startswith(prefix)] if length else told
        assert len(inside) == len(part)  # no larger set shares it


# --- near duplicates -----------------------------------------------------------------------------


def brute_print(text, words=4):
    told = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not told:
        return 0
    runs = [" ".join(told[i : i + words]) for i in range(len(told) - words + 1)] or [" ".join(told)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, near):
    parent = list(range(len(keys)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(keys))]


def near_corpus(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in "xyz"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            told = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 2)):
                told[rng.randrange(len(told))] = rng.choice(vocabulary)
            rows.append((1000 - i, " ".join(told)))
        else:
            rows.append((1000 - i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 120)))))
    return [*rows, (5, None), (6, ""), (7, "One"), (8, "oNE"), (9, "one two three"), (10, "É é"), rows[0], (11, "w " * 50_000)]


@pytest.mark.parametrize("tile", [4096, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, tile):
    rows = near_corpus()
    links = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda prints, radius: links(prints, radius, tile))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect())
    prints = [brute_print(t) for _, t in rows]
    of = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (doc, _), c in zip(rows, of):
        least[c] = min(doc, least.get(c, doc))
    assert got == sorted((doc, f"{p:016x}", least[c]) for (doc, _), p, c in zip(rows, prints, of))
    assert len(set(least.values())) < len(rows)


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(table(spark, [(None, "a b c"), (4, "a b c"), (None, "q r s t u")])).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


def test_similar_documents_match_brute_force(spark):
    rows = [r for r in near_corpus(9, 120)]
    got = {(r.doc_id, r.component_id) for r in simhash.similar_documents(table(spark, rows)).collect()}

    def shingles(t):
        w = words_of((t or "").lower())
        return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)][: len(w)])

    keys = [shingles(t) for _, t in rows]
    of = brute_components(keys, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    least = {}
    for (doc, _), c in zip(rows, of):
        least[c] = min(doc, least.get(c, doc))
    want = {(doc, least[c]) for (doc, _), c in zip(rows, of)}
    assert got == want


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = words_of((t or "").lower())
        out.append(frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)][: len(w)]))
    return out


def brute_similar(rows):
    """The pairs (doc_id, component_id) of exact similarity."""
    least, of = {}, brute_components(shingle_sets(rows), lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    for (doc, _), c in zip(rows, of):
        least[c] = min(doc, least.get(c, doc))
    return {(doc, least[c]) for (doc, _), c in zip(rows, of)}


def test_copies_of_one_document_are_one_group(spark):
    """Each copy is near the base document only; links among the copies fail."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(204)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        told = list(base)
        for at in rng.sample(range(4, 200, 6), 4):
            told[at] = f"x{i}-{at}"
        rows.append((i, " ".join(told)))
    want = brute_similar(rows)
    assert {c for _, c in want} == {0}
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(table(spark, rows)).collect()} == want


def test_sets_just_similar_are_linked_whatever_their_size(spark):
    """Pairs of sets of k shingles out of 1.25 k: a similarity of 0.8 or a little more."""
    rows, pairs = [], []
    for size in (4, 5, 8, 11, 12, 13, 20, 60, 200):
        for k in range(30):
            told = [f"{size}-{k}-{i}" for i in range(size + 4)]
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(told)), (len(rows) + 1, " ".join(told + [f"more{i}" for i in range(size // 4)]))]
    want = brute_similar(rows[:240]) | {(x, i) for i, j in pairs[120:] for x in (i, j)}
    assert want == {(x, i) for i, j in pairs for x in (i, j)}
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(table(spark, rows)).collect()} == want


def test_similarity_is_that_of_sets_where_texts_repeat_themselves(spark):
    """A body told three times is near the same body told once; so are texts that repeat different lines."""
    body = [f"w{k}" for k in range(100)]
    lines = [" ".join(f"{a}{k}" for k in range(40)) for a in "pqrs"]
    rows = [(1, " ".join(body)), (None, " ".join(body * 3)), (3, " ".join(lines + lines[:1] * 9)), (4, " ".join(lines + lines[3:] * 9))]
    want = brute_similar([(i or 2, t) for i, t in rows])
    assert {c for _, c in want} == {1, 3}
    assert {(r.doc_id or 2, r.component_id) for r in simhash.similar_documents(table(spark, rows)).collect()} == want


@pytest.mark.parametrize("tile", [4096, 8])
def test_similar_documents_behind_frequent_shingles(spark, monkeypatch, tile):
    """Passages that most documents share neither hide a near copy nor link what is not one."""
    rng = random.Random(12)
    line = " ".join(f"l{k}" for k in range(60))
    rows = []
    for i in range(120):
        own = [f"{i}-{k}" for k in range(rng.choice([3, 20, 70]))]
        rows.append((i, " ".join([line, *own])))
        if i % 4 == 0:
            own[rng.randrange(len(own))] = "other"
            rows.append((1000 + i, " ".join([line, *own])))
    links = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda sets, similarity: links(sets, similarity, tile))
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(table(spark, rows)).collect()} == brute_similar(rows)


@pytest.mark.parametrize("tile, crowd", [(4, 4096), (4, 8), (1, 4096)])
def test_groups_of_many_tiles_are_verified_whole(spark, monkeypatch, tile, crowd):
    """Candidate groups that fall into several parts: chains of texts of which neighbours are too far apart, or just near enough."""
    rng = random.Random(8)
    rows, told = [], [f"c{k}" for k in range(60)]
    for i in range(90):  # steps of one word are a similarity of 50 of 62 shingles or so, of two words or three less
        told = list(told)
        for _ in range(rng.choice([1, 1, 2, 3])):
            told[rng.randrange(60)] = f"d{rng.randrange(10_000)}"
        rows.append((i, " ".join(told)))
    links = simhash.similar_links
    pairs = simhash.candidate_pairs
    opened = []

    def told_pairs(sets, similarity):
        got, crowded = pairs(sets, similarity, crowd)
        opened.append((got.count(), crowded is not None))
        return got, crowded

    monkeypatch.setattr(simhash, "similar_links", lambda sets, similarity: links(sets, similarity, crowd))
    monkeypatch.setattr(simhash, "candidate_pairs", told_pairs)
    want = brute_similar(rows)
    assert 10 < len({c for _, c in want}) < 80
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(table(spark, rows), tile=tile).collect()} == want
    assert opened and opened[0][0] > 0 and (crowd > 8 or opened[0][1])


def test_sets_that_share_half_a_name_are_not_equal(spark):
    """Names cut to two bits: nearly all sets share one with others."""
    rows = near_corpus(4, 60)
    want = brute_similar(rows)
    assert {(r.doc_id, r.component_id) for r in simhash.similar_documents(table(spark, rows), bits=2).collect()} == want
    kept = sorted(r.doc_id for r in simhash.dedup(table(spark, rows), bits=2).collect())
    assert kept == sorted({c for _, c in want})  # one id is there twice: one row of it stays


@pytest.mark.parametrize("sides", [1, 2])
def test_link_sets_match_brute_force(sides):
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(120):
        kept = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.integers(0, 500, rng.integers(1, 60)).astype(np.uint64)
        kept = kept[rng.random(len(kept)) > 0.06]
        sets.append(np.unique(np.append(kept, rng.integers(0, 500, rng.integers(1, 3)).astype(np.uint64))))
    side = np.arange(120) % sides
    a, b = tiles.link_sets(np.concatenate(sets), np.array([len(s) for s in sets]), side, 0.8)
    pairs = [(i, j) for i in range(120) for j in range(i) if sides == 1 or side[i] != side[j]]
    true = {(i, j) for i, j in pairs if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    got = {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert got <= true and true
    assert brute_components(range(120), lambda i, j: (i, j) in got) == brute_components(range(120), lambda i, j: (i, j) in true)


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v w"), (9, None), (8, ""), (2, "q r s t u v w")]
    got = simhash.dedup(table(spark, rows))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 8]
    assert simhash.dedup(table(spark, [])).count() == 0


def test_registered_results(spark, sf_dir):
    from attestry.llm import registry

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in registry.queries()["op4_suffix_dedup"](spark, sf_dir).collect()}
    for doc, n, removed, spans, kept in brute_bytes(docs, 400):
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    prints = {doc: brute_print(t) for doc, t in docs}
    told = registry.queries()["op6_simhash_near_dedup"](spark, sf_dir)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" for r in told.collect())
    assert told.where(F.col("component_id") > F.col("doc_id")).count() == 0
