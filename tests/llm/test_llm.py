"""The corpus operators against brute force, SQL, round trips and held-out labels, and on awkward tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sievewall.llm import exact_dedup, language_id, licenses, lm_score, mixing, near_dedup, phrases, piece_bpe, queries, secrets, similarity, topk, toxicity, url_filter, vector_codes
from sievewall.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, digest string, body string, copies int, key int"


def awkward(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    texts = [None, "", " \n\t", "a", "the and of", "the  and\tof", "long " * 30_000 + "end", "ünïcödé \U0001f600 x ▁ y", "x" * 50_000, "password=abcdefgh12345", "the and of"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, 7, True, 0.5, "d", "b", 9, 1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "the and of", "de", "s1", 1, 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def none_of(frame):
    return frame.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# 1 language


def brute_word(word, lattice, probability):
    """Sum over every segmentation, spelt out."""
    pieces = lattice.numbers if hasattr(lattice, "numbers") else dict(zip(lattice.names, range(len(lattice.names)), strict=True))
    lattice.numbers = pieces
    text, total = "▁" + word, 0.0

    def go(at, p):
        nonlocal total
        if at == len(text):
            total += p
        for n in range(1, min(lattice.longest, len(text) - at) + 1):
            piece = text[at : at + n]
            if piece in pieces:
                go(at + n, p * probability[pieces[piece]])
            elif n == 1:
                go(at + 1, p * probability[-1])

    go(0, 1.0)
    return np.log(total)


def test_forward_sums_all_segmentations():
    names = sorted({"▁", "▁a", "a", "b", "ab", "ba", "abb", "▁ab"})
    lattice = language_id.Lattice(names)
    lattice.names = names
    p = np.random.default_rng(1).dirichlet(np.ones(lattice.size), 2).T
    words = ["abba", "a", "zab", "bbbb", "abab" * 4]
    got = lattice.forward(words, p)
    want = [[brute_word(w, lattice, p[:, k]) for k in range(2)] for w in words]
    assert np.allclose(got, want)
    counts = lattice.expected(words, np.ones(len(words)), p[:, 0])
    eps = 1e-6
    for piece in range(lattice.size):
        q = p[:, 0].copy()
        q[piece] *= 1 + eps
        slope = (lattice.forward(words, q[:, None]).sum() - lattice.forward(words, p[:, :1]).sum()) / eps
        assert abs(slope - counts[piece]) < 1e-3


def test_words_of_any_length_are_summed_whole(monkeypatch):
    """Against the sum place by place in logarithms, over words far beyond a stretch and beyond what a double holds."""
    monkeypatch.setattr(language_id, "STRETCH", 64)
    names = sorted({"▁", "▁a", "a", "b", "ab", "ba", "abbabbabba", "▁abbab"})
    lattice = language_id.Lattice(names)
    p = np.random.default_rng(2).dirichlet(np.ones(lattice.size), 2).T
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 63, 64, 65, 500, 5000)] + ["abbabbabba" * 300, "z" * 900]
    for word, got in zip(words, lattice.forward(words, p), strict=True):
        text, sums = "▁" + word, [np.zeros(2)]
        for end in range(1, len(text) + 1):
            terms = [sums[end - n] + np.log(p[names.index(text[end - n : end])]) for n in lattice.lengths if n <= end and text[end - n : end] in names]
            sums.append(np.logaddexp.reduce(terms or [sums[end - 1] + np.log(p[-1])]))
        assert np.allclose(got, sums[-1], rtol=1e-9)
    assert lattice.forward(words, p)[5].max() < -750


def test_language_query_matches_brute_force(spark):
    """Every short text of a small table, by segmentations spelt out under the query's own model."""
    frame = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat sat on a mat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("Ünder 12 öl", None), ("", "en"), (None, "de"), ("chat katze cat", "fr")] * 3)], "doc_id long, text string, lang string")
    model = language_id.train(frame, queries.model_file())
    model.lattice.names = language_id.vocabulary_of(queries.model_file())
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.probability.sum(axis=0), 1)
    known = {}
    for r in language_id.identify(frame, model).collect():
        words = re.findall(r"[^\W\d_]+", (frame.where(F.col("doc_id") == r.doc_id).first().text or "").lower())
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        for w in words:
            known[w] = known[w] if w in known else np.array([brute_word(w, model.lattice, model.probability[:, k]) for k in range(3)])
        total = sum(known[w] for w in words)
        best = int(total.argmax())
        assert r.lang_pred == model.languages[best] and abs(r.score - 1 / np.exp(total - total[best]).sum()) < 1e-9


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)


def test_language_of_awkward_rows(spark):
    frame = awkward(spark)
    model = language_id.train(frame.select("doc_id", "text", "lang"), queries.model_file())
    found = [(r.lang_pred, r.score) for r in language_id.identify(frame, model).collect()]
    assert len(found) == frame.count() and Counter(x for x, _ in found)["und"] == 4
    assert language_id.identify(none_of(frame), model).collect() == []
    assert language_id.train(none_of(frame), queries.model_file()) is None
    assert {r.lang_pred for r in language_id.identify(frame, None).collect()} == {"und"}


# 2 exact dedup


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    return groups


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "a b", "ab", "a  b", "abc", "abd", "b" * 100, "b " * 100, "bb", "\u3000ab"])) for i in range(300)] + [(None, "ab"), (7, "ab")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for budget in (1, 2000, 1 << 25):
        groups = brute_exact(rows)
        for r in exact_dedup.exact_groups(frame, budget=budget).collect():
            match = [(k, v) for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256]
            best = min(match[0][1])
            assert r.group_size == len(match[0][1]) and r.keep_id == best[2] and r.kept == (r.doc_id == best[2])


def test_trie_spills_and_keeps_everything():
    rng = random.Random(5)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    trie = exact_dedup.Patricia(20_000)
    for i, body in enumerate(bodies):
        trie.add(body, ["", len(body) % 3, i, 1, 1])
    assert trie.spilled
    found = dict(trie.drain())
    assert {k: v[3] for k, v in found.items()} == Counter(bodies)
    assert all(v[2] == bodies.index(k) for k, v in found.items())


def test_exact_awkward_rows(spark):
    frame = awkward(spark)
    found = exact_dedup.exact_groups(frame).collect()
    assert len(found) == frame.count() and {r.group_size for r in found} >= {1, 4, 5}
    assert exact_dedup.exact_groups(none_of(frame)).collect() == []
    kept = exact_dedup.keep_first_copies(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7, 8, 9}


# 3 near dedup


def brute_near(rows, percent=85):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    label = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_groups_match_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 5, 40, 120, 300]))] for _ in range(30)]
    rows = []
    for i in range(500):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
    rows += [(1000, None), (1001, ""), (1002, "w1"), (1003, "W1"), (1004, " ")]
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_near(rows)


def test_near_copies_from_four_fifths_on(spark):
    """Three words of 150 changed far apart: 131 of 161 shingles, 0.81; five of them changed: 0.71."""
    rows = []
    for i in range(40):
        own = [f"d{i}w{k}" for k in range(150)]
        rows.append((3 * i, " ".join(own)))
        for j, n in ((1, 3), (2, 5)):
            rows.append((3 * i + j, " ".join(f"x{i}{j}{k}" if k % 25 == 10 and k // 25 < n else w for k, w in enumerate(own))))
    kept = near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), percent=80, bands=36)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(120) if i % 3 != 1]


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    template = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(template)
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    for shingles in (1 << 19, 1000):
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
        found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_near(rows)


def test_members_that_no_lead_links_meet_in_blocks(spark, monkeypatch):
    """Families that share bands by their common half, so that a bucket holds several components."""
    rng = random.Random(14)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    common = [f"c{i}" for i in range(100)]
    rows = []
    for family in range(6):
        own = [f"f{family}w{k}" for k in range(30)]
        for i in range(12):
            words = [*common, *own]
            words[rng.randrange(len(words))] = f"z{family}{i}"
            rows.append((family * 100 + i, " ".join(words)))
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = brute_near(rows)
    assert len({x[1] for x in wanted.values()}) > 1 and {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == wanted


def test_many_rows_without_an_id_meet_their_own_text_only(spark, monkeypatch):
    """2,000 near copies without an id: each text is read once for its set, not once for each row without an id."""
    sent = []
    read = near_dedup.shingles_of
    monkeypatch.setattr(near_dedup, "shingles_of", lambda texts: (sent.append(texts.count()), read(texts))[1])
    template = [f"t{i}" for i in range(60)]
    rows = [(None, " ".join([*template[: i % 50], f"x{i}", *template[i % 50 :]])) for i in range(2000)]
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(found) == 2000 and sent == [2000] and {r.component_id for r in found} == {None}


def test_a_bucket_of_thousands_is_compared_with_its_lead(spark, monkeypatch):
    """5,000 distinct near copies and 30 others that share their bands: sets are sent once to the lead, and only the others' blocks meet."""
    sent = []
    verified = near_dedup.verified_links
    monkeypatch.setattr(near_dedup, "verified_links", lambda rows, sets, percent: (sent.append(rows.count()), verified(rows, sets, percent))[1])
    template = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([*template, f"x{i}"])) for i in range(5000)] + [(6000 + i, " ".join([*template, *(f"y{i}w{k}" for k in range(40))])) for i in range(30)]
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert all(r.component_id == (0 if r.doc_id < 5000 else r.component_id) for r in found)
    assert {r.doc_id: r.component_id for r in found if r.doc_id >= 6000} == {6000 + i: 0 if 100 * 196 >= 85 * (196 + 1 + 40) else 6000 + i for i in range(30)}
    # A member meets its leads and, in each of its 25 bands, the block of the others; not every other block.
    assert sum(sent) < 2 * 25 * 5000


def test_blocks_are_bounded_by_shingles_and_all_labels_meet(spark):
    """300 members of 20,000 shingles in one bucket, 60 of them of one label: a task holds two blocks, and members of two labels meet once."""
    members = [("k", f"d{i}".encode(), 20_000, b"one" if i < 60 else f"d{i}".encode()) for i in range(300)]
    rows = spark.createDataFrame([(1, *x[1:]) for x in members], "key long, digest binary, n_shingles long, label binary")
    labels = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    meetings = {}
    for r in near_dedup.block_rows(rows, labels).collect():
        meetings.setdefault((r.low, r.high), []).append((r.block, bytes(r.digest), bytes(r.label)))
    assert max(len(own) for own in meetings.values()) * 20_000 < 4 * near_dedup.BLOCK_SHINGLES
    met = Counter()
    for own in meetings.values():
        several = len({x[0] for x in own}) > 1
        met.update(tuple(sorted((x[1], y[1]))) for i, x in enumerate(own) for y in own[:i] if x[2] != y[2] and (not several or x[0] != y[0]))
    wanted = {tuple(sorted((x[1], y[1]))) for i, x in enumerate(members) for y in members[:i] if x[3] != y[3]}
    assert set(met) == wanted and set(met.values()) == {1}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 3, 30, 1000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 4] = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
        s = similarity.sketches([np.unique(a), np.unique(b)], 512)
        assert (s < np.iinfo(np.uint64).max).all()
        assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    label = {x: x for pair in links for x in pair}
    for _ in range(400):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    singles = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert found == {k: v for k, v in label.items() if k not in singles}


def test_one_of_repeated_rows_stays(spark):
    """Rows that repeat under one id, or without one, leave one of them in either dedup stage."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, 1)] * 4 + [(5, text, 2)] + [(None, text + " more", 3)] * 3 + [(6, "alone", 1)] * 2 + [(7, "", 1)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    assert Counter((r.doc_id, r.text) for r in exact_dedup.keep_first_copies(frame).collect()) == Counter({(5, text): 1, (None, text + " more"): 1, (6, "alone"): 1, (7, ""): 1})
    # Empty texts are near copies of nothing.
    assert Counter((r.doc_id, r.text) for r in near_dedup.keep_one_of_each(frame).collect()) == Counter({(5, text): 1, (6, "alone"): 1, (7, ""): 2})


def test_near_awkward_rows(spark):
    frame = awkward(spark)
    found = near_dedup.near_groups(frame).collect()
    assert len(found) == frame.count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[10].component_id == 4 and not by_id[10].kept and by_id[0].kept and by_id[0].n_shingles == 0
    assert near_dedup.near_groups(none_of(frame)).collect() == []


# 4 toxicity


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in found if r.toxic == 1], [r for r in found if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_noisy_or_and_offending_sentences(spark):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            sentences[rng.randrange(5)] += " beastly"
        rows.append((i, "Ä. " + ". ".join(sentences) + ".", int(i % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    found = toxicity.toxic_sentences(frame, toxicity.train(frame, frame)).collect()
    text = {r[0]: r[1] for r in rows}
    for r in found:
        assert (r.score >= 0.3) == (r.doc_id % 4 == 0)
        assert all("beastly" in text[r.doc_id][s.start : s.end] for s in r.sentences) and (len(r.sentences) > 0) == (r.doc_id % 4 == 0)


def test_long_and_many_documents_leave_the_toxic_ones_in_the_sample(spark):
    """Few toxic documents, many clean ones and a very long one, with a third of the features that they have."""
    rng = random.Random(19)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(800):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(2_000 if i == 5 else 5)]
        if i % 40 == 0:
            sentences[rng.randrange(5)] += " beastly"
        rows.append((i, ". ".join(sentences) + ".", int(i % 40 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(frame, frame, most_features=130_000)
    # The 2,000 sentences of the long one are not judged: its score adds up those of far more sentences than any other has.
    found = {r.doc_id: r.score >= 0.3 for r in toxicity.toxic_sentences(frame, model).collect() if r.doc_id != 5}
    assert found == {i: label == 1 for i, _, label in rows if i != 5}


def test_whole_rows_are_admitted_in_order():
    taken = lambda sizes, most: toxicity.admitted(np.array(sizes, np.int64), most).tolist()
    assert taken([3, 9, 4, 2], 9) == [True, False, True, True] and taken([3, 4], 7) == [True, True] and taken([], 5) == []
    assert taken([9, 8, 8], 5) == [False, True, False]


def test_repeated_ids_leave_the_sample_bounded(spark, monkeypatch):
    """3,000 rows under one id and label, half of them equal: no more than twice the asked rows are learnt from, equal ones once."""
    learnt = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda feature, sentence, text_of, label, *more: (learnt.append(np.bincount(label, minlength=2).tolist()), fit(feature, sentence, text_of, label, *more))[1])
    docs = spark.createDataFrame([(7, f"w{i} is vile" if i % 2 else "the same vile text") for i in range(3000)] + [(i, f"fine w{i}") for i in range(100, 120)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, 0) for i in range(100, 120)], "doc_id long, label int")
    toxicity.train(docs, labels, docs_per_class=50)
    toxicity.train(docs.where("doc_id <> 7 or text like 'the same%'"), labels, docs_per_class=50)
    assert learnt == [[20, 100], [20, 1]]


def test_a_step_follows_the_gradient_of_the_likelihood():
    """The first step of Adagrad moves each weight by the rate against the sign of the likelihood's slope, taken by differences."""
    rng = np.random.default_rng(6)
    feature, sentence = rng.integers(0, 6, 40), np.sort(rng.integers(0, 12, 40))
    sentence = np.unique(sentence, return_inverse=True)[1]
    text_of = np.sort(rng.integers(0, 5, sentence.max() + 1))
    label, weight = np.array([1, 0, 1, 0, 0]), np.array([1.0, 2.0, 1.0, 1.0, 3.0])

    def loss(w, bias):
        p = 1 / (1 + np.exp(-(np.bincount(sentence, weights=w[feature]) + bias)))
        s = np.array([1 - np.prod(1 - p[text_of == i]) for i in range(5)])
        return -(weight * np.log(np.where(label == 1, s + 1e-12, 1 - s))).sum() / weight.sum()

    model = toxicity.fit(feature, sentence, text_of, label, weight, 1, 0.5, 0.0)
    for k in range(6):
        w = np.zeros(6)
        w[k] = 1e-3
        slope = (loss(w, -8.0) - loss(-w, -8.0)) / 2e-3
        assert np.isclose(model.weights[k], -0.5 * slope / np.sqrt(1e-8 + slope**2), rtol=1e-2, atol=1e-4)


def test_toxicity_query_matches_brute_force(spark, docs):
    """Sentences, words and beginnings spelt out, under the query's own model."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = queries.toxicity_model(docs, labels)
    number = {}
    for r in queries.op4_toxicity(spark, SF).collect():
        number[r.doc_id] = r
    for r in docs.limit(60).collect():
        s = 0.0
        for part in re.split(r"[.!?\n\r]", r.text or ""):
            words = re.findall(rb"[A-Za-z0-9'\x80-\xff]+", part.encode())
            if words:
                parts = [w[:n] for w in words for n in toxicity.PREFIXES if len(w) > n] + words
                features = [int(toxicity.prefix_hashes(np.frombuffer(x.lower(), np.uint8), np.array([0]), np.array([len(x)]), ())[-1][1][0] & np.uint64(toxicity.FEATURES - 1)) for x in parts]
                s += np.logaddexp(0, sum(float(model.weights[f]) for f in features) + model.bias)
        want = -np.expm1(-(s or np.logaddexp(0, model.bias)))
        assert abs(number[r.doc_id].score - want) < 1e-6 and number[r.doc_id].predicted == int(number[r.doc_id].score >= 0.3)


def test_toxicity_awkward_rows(spark):
    frame = awkward(spark)
    model = toxicity.train(frame, frame.select("doc_id", (F.col("doc_id") == 9).cast("int").alias("label")))
    found = toxicity.toxic_sentences(frame, model).collect()
    assert len(found) == frame.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxic_sentences(none_of(frame), model).collect() == []
    assert toxicity.train(frame, none_of(frame).select("doc_id", F.lit(1).alias("label"))).bias == -8.0


# 5 secrets


def brute_spans(text):
    keywords = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[Aa][Pp][Ii]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
    found = [("assign", *m.span()) for m in re.finditer(rf"({keywords})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def test_base_spans_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_secret_scan(spark, sf).collect():
        wanted = brute_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in wanted)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in wanted) for x in ("assign", "access", "hex"))


def test_spans_of_hard_texts(spark):
    hexes = "0123456789abcdef" * 3
    texts = [
        "token = secret: abcdefgh12", "PassWord'  :  'abc.def-ghi=' api_KEY=ABCDEFGH", "\U0001f600 é token=" + hexes, "AKIAAKIA" + "B" * 20 + " AKIA12 AKIA" + "C" * 12, "token=short token=longenough1",
        hexes[:31] + "g" + hexes[:32], "passwd==abcdefghij", "api-key=abcdefghij apikey:\"abcdefghij", None, "", "tokentoken=abcdefgh;secret=\nabcdefgh", "a" * 31 + "\n" + "b" * 32 + "B",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.secret_spans(frame).collect():
        assert [tuple(s) for s in r.base] == brute_spans(texts[r.doc_id] or ""), texts[r.doc_id]


def test_battery_finds_random_strings_and_leaves_words(spark):
    rng = random.Random(21)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "see " + "".join(rng.choice(alphabet) for _ in range(48)) + " there") for i in range(200)]
    rows += [(1000 + i, "see " + rng.choice(["aaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabc1", "version1version1version1version1version1version1"]) + " there") for i in range(200)]
    found = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len(r.spans) for r in found if r.doc_id < 1000) >= 180 and not any(s.kind == "random" for r in found if r.doc_id >= 1000 for s in r.spans)
    assert all((s.start, s.end, s.kind) == (4, 52, "random") for r in found if r.doc_id < 1000 for s in r.spans)


def tail(z):
    return 1 / (1 + np.exp(1.5976 * z + 0.07056 * z**3))


def brute_p(value):
    """The p-value by which a string is reported: 1 if the battery dismisses chance, else that of words."""
    alphabet = next(a for _, pattern, a in secrets.ENCODINGS if re.search(pattern, value))
    codes, k, n = np.array([alphabet.index(c) + 1.0 for c in value]), len(alphabet), len(value)
    chi, spread = sum(value.count(c) ** 2 for c in alphabet) * k / n - n, 2 / (9 * (k - 1))
    p_chi = tail(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - spread)) / np.sqrt(spread))
    high = codes > k / 2
    expected = 2 * high.sum() * (n - high.sum()) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    p_runs = 2 * tail(abs(1 + (high[1:] != high[:-1]).sum() - expected) / np.sqrt(variance)) if variance > 0 else 0
    centred = codes - codes.mean()
    p_serial = 2 * tail(abs((centred[1:] * centred[:-1]).sum() / (centred**2).sum() * np.sqrt(n) + 1 / np.sqrt(n))) if (centred**2).sum() > 0 else 0
    if 1 - (1 - min(p_chi, p_runs, p_serial, 1)) ** 3 < secrets.NOT_BY_CHANCE:
        return 1.0
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in value if c.isalnum()]
    letters = [c.lower() for c in value if c.isalpha()]
    steps, m = max(len(classes) - 1, 1), len(letters)
    z_runs = (sum(a != b for a, b in zip(classes[1:], classes[:-1], strict=True)) - steps / 4) / np.sqrt(steps * 3 / 16)
    y, s2, s3 = sum(v * (v - 1) for v in Counter(letters).values()), secrets.LETTER_SQUARES, secrets.LETTER_CUBES
    z_letters = (m * (m - 1) * s2 - y) / np.sqrt(4 * m * (m - 1) * (m - 2) * (s3 - s2**2) + 2 * m * (m - 1) * (s2 - s2**2)) if m >= 3 else 0
    return tail((z_runs + z_letters) / np.sqrt(2))


def test_random_spans_match_brute_force(spark):
    """Strings of all lengths and encodings among words: the reported ones are those of Benjamini and Hochberg's rule on the battery spelt out."""
    rng = random.Random(31)
    made = [identifier(rng) for _ in range(300)] + ["".join(rng.choice(rng.choice([a for _, _, a in secrets.ENCODINGS])) for _ in range(rng.randint(20, 150))) for _ in range(60)]
    made += ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 70))) for _, _, alphabet in secrets.ENCODINGS for _ in range(12)]
    texts = [f"see {x} and {y}." for x, y in zip(made, made[1:] + made[:1], strict=True)]
    found = [(i, m.start(), m.end(), brute_p(m[0])) for i, t in enumerate(texts) for m in re.finditer(secrets.CANDIDATE, t) if not any(a < m.end() and m.start() < b for _, a, b in brute_spans(t))]
    wanted = set()
    for low, high in zip(secrets.STRATA, [*secrets.STRATA[1:], 1 << 30], strict=True):
        own = sorted((x for x in found if low <= x[2] - x[1] < high), key=lambda x: x[3])
        rounded = [10 ** (-np.floor(-np.log10(max(x[3], 1e-20)) * 200) / 200) for x in own]
        passed = [k for k, p in enumerate(rounded) if p <= 0.05 * sum(q <= p for q in rounded) / len(own)]
        wanted |= {x[:3] for x in own[: max(passed, default=-1) + 1]}
    rows = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert 40 < len(wanted) < len(found) and {(r.doc_id, s.start, s.end) for r in rows for s in r.spans if s.kind == "random"} == wanted


WORDS = "payload window buffer handler filter request user index cache value table token parse render update config module stream output reader writer session manager context".split()


def identifier(rng):
    """Words and a number, in one of the usual spellings, of 20 characters at least."""
    words = [rng.choice(WORDS) for _ in range(rng.randint(3, 5))]
    words.insert(rng.randrange(len(words) + 1), str(rng.choice([8, 32, 64, 256, 2024, rng.randrange(1000)])))
    name = rng.choice(["_".join, "-".join, "/".join, lambda w: "".join(x.capitalize() for x in w), lambda w: w[0] + "".join(x.capitalize() for x in w[1:])])(words)
    return name if len(name) >= 20 else identifier(rng)


def test_identifiers_are_not_secrets(spark):
    """600 identifiers with a number, with and without real secrets beside them: under 2 % are reported."""
    rng = random.Random(33)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = [(i, f"call {identifier(rng)} now") for i in range(600)]
    keys = [(1000 + i, "see " + "".join(rng.choice(alphabet) for _ in range(48)) + " there") for i in range(200)] + [(2000 + i, "see " + "".join(rng.choice(alphabet) for _ in range(24)) + " there") for i in range(100)]
    for rows in (names, names + keys):
        found = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(s.kind == "random" for r in found if r.doc_id < 1000 for s in r.spans) < 12
    assert sum(len(r.spans) for r in found if 1000 <= r.doc_id < 2000) >= 180 and sum(len(r.spans) for r in found if r.doc_id >= 2000) >= 80


def test_positions_of_very_many_matches(spark):
    """More matches in one text than a block of positions holds."""
    text = "\U0001f600 token=abcdefgh12 " * 3000
    row = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [tuple(s) for s in row.base] == brute_spans(text)


def test_secrets_awkward_rows(spark):
    frame = awkward(spark)
    assert secrets.secret_spans(frame).count() == frame.count()
    assert secrets.secret_spans(none_of(frame)).collect() == []


# 6 URLs


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(d + p), d + p, v) for v, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_fixed_rules(spark):
    urls = ["http://a.example.com/en/x", "https://www.example.com/en/", "http://WWW.EXAMPLE.COM/en/1?q", "http://example.com", "http://example.com/", "http://net/es/", "http://a.net/fr/b#c", "http://a.net/frx", "x://y://net/es/", "no scheme", None, "", "://net/es/", "http://xnet/es/", "http://a.net?/es/", "http://a\nb.net/es/"]
    rows = url_filter.judged_urls(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()
    for r in rows:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict), urls[r.page_id]
    assert len(rows) == len(urls)


def test_mined_verdicts_match_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in url_filter.judged_urls(pages).collect()}
    tokens = {r.page_id: (r.url, r.t) for r in pages.select("page_id", "url", url_filter.url_tokens(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("t")).collect()}
    labelled = [(frozenset(tokens[i][1]), brute_rule(tokens[i][0])[3]) for i in tokens if brute_rule(tokens[i][0])[3]]
    from itertools import combinations

    single = Counter(x for t, _ in labelled for x in t)
    least = np.ceil(0.02 * len(labelled))
    sums, both = Counter(), Counter()
    for t, v in labelled:
        for n in (1, 2, 3):
            for c in combinations(sorted(x for x in t if single[x] >= least), n):
                sums[c] += 1
                both[c, v] += 1
    rules = [(-(n / sums[c]), -(n / len(labelled)), -len(c), "\n".join(c), v != "block", c, v) for (c, v), n in both.items() if n >= least and n / sums[c] >= 0.75]
    rules = [r for r in rules if not any(s[6] == r[6] and s[0] <= r[0] and set(s[5]) < set(r[5]) for s in rules)]
    for i, (url, t) in tokens.items():
        host, path, rule, verdict = brute_rule(url)
        fired = [r for r in rules if set(r[5]) <= set(t)]
        assert found[i].verdict == (verdict or (min(fired)[6] if fired and host else "allow"))
    assert {r.verdict for r in found.values() if r.rule is None} == {"allow", "block"}


def test_mining_of_urls_with_many_tokens_is_bounded(spark):
    """Forty path segments that always come together, and a very long URL: as one token each."""
    deep = "/".join(f"p{k}" for k in range(40))
    urls = [f"http://a{i}.net/es/{deep}?{'&'.join(f'k{k}=1' for k in range(i % 30))}" for i in range(60)] + [f"http://b{i}.com/x{i % 3}" for i in range(60)]
    urls += ["http://c.org/es/q/p1", "http://c.org/zz", "http://d.org/" + "s/" * 20_000 + "?" + "&".join(f"k{k}" for k in range(5_000))]
    found = {r.page_id: r for r in url_filter.judged_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [found[i].verdict for i in (0, 59, 60, 119)] == ["block", "block", "allow", "allow"] and len(found) == len(urls)
    # p1 is a token of the third place in both.
    assert found[120].verdict == "block" and found[121].verdict == "allow"


@pytest.mark.parametrize("longest", [2, 3])
def test_mined_rules_are_exact_whatever_the_number_of_tokens(spark, longest):
    """Sixteen to thirty frequent tokens a URL, common ones that mean nothing and two that matter only together: every rule, with its figures on whole sets."""
    from itertools import combinations

    rng = random.Random(longest)
    labelled = []
    for _ in range(300):
        tokens = {f"f{k:02d}" for k in range(26) if rng.random() < 0.85} | {x for x in ("x1", "x2", "y") if rng.random() < 0.5} | {"z1", "z2"}
        odd = ("x1" in tokens) != ("x2" in tokens)
        labelled.append((sorted(tokens), "block" if odd and rng.random() < 0.97 else "allow"))
    assert all(16 <= len(t) <= 31 for t, _ in labelled)
    least, sums, both = math.ceil(0.05 * len(labelled)), Counter(), Counter()
    for t, v in labelled:
        for n in range(1, longest + 1):
            for c in combinations(t, n):
                sums[c] += 1
                both[c, v] += 1
    rules = {(c, v): (n / sums[c], n / len(labelled)) for (c, v), n in both.items() if n >= least and n / sums[c] >= 0.9}
    kept = {k: r for k, r in rules.items() if not any((s, k[1]) in rules and rules[s, k[1]][0] >= r[0] for m in range(1, len(k[0])) for s in combinations(k[0], m))}
    found = url_filter.mined_rules(spark.createDataFrame(labelled, "tokens array<string>, verdict string"), 0.05, 0.9, longest).collect()
    own = {(tuple(r["items"]), r.verdict): (r.confidence, r.support) for r in found}
    # z1 and z2 always come together, so that a rule with both says no more than one with either.
    assert set(own) == {k for k in kept if not {"z1", "z2"} <= set(k[0])}
    assert all(np.allclose(own[k], kept[k]) for k in own) and len(own) == len(found)


def test_urls_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged_urls(empty).collect() == []
    odd = spark.createDataFrame([(1, None), (1, None), (2, "http://a.org/x"), (2, "http://a.org/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judged_urls(odd).collect()] == ["allow"] * 4


# 7 SentencePiece


def texts_for_pieces():
    rng = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "▁", "é", "日", "\U0001f600", "0", "=", ".", "<s>", "<0x0A>", "\t", "\x00", "\x01", " " * 17, "aa", "--"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    return [None, "", *made, *("a" * n for n in range(60)), *(" " * n for n in range(60)), *("ab" * n for n in range(60)), "日本" * 5000, "x" * 20_000]


def test_pieces_equal_the_library(spark):
    texts = texts_for_pieces()
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = piece_bpe.decode(piece_bpe.encode(frame, queries.model_file(), decoded="same"), queries.model_file()).collect()
    for r in found:
        assert r.same == r.decoded
        wanted = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.ids == wanted and r.decoded == sp.decode(wanted), repr(texts[r.doc_id])[:200]


def test_piece_digests(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op7_sentencepiece(spark, SF).collect():
        ids = sp.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_units_start_anew(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MOST_UNITS", 10)
    model = piece_bpe.PieceModel(queries.model_file())
    encoder, sp = piece_bpe.Encoder(model), sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    for text in ("one two three four", "five six seven eight nine ten", "one two three") * 3:
        assert encoder.ids(text) == sp.encode(text, add_eos=True)


def test_pieces_awkward_rows(spark):
    frame = awkward(spark).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    out = piece_bpe.decode(piece_bpe.encode(frame, queries.model_file()), queries.model_file())
    assert out.count() == frame.count() and set(out.columns) == set(frame.columns)
    assert piece_bpe.encode(none_of(frame), queries.model_file()).collect() == []


# 8 LM scores


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_losses(target, docs):
    """A document's losses under the target and under all other documents, by its number; both sides are lists of word lists."""
    single = [Counter(w for t in side for w in t) for side in (target, docs)]
    pair = [Counter(p for t in side for p in zip([None, *t], t, strict=False)) for side in (target, docs)]
    texts, n_words = [sum(map(bool, side)) for side in (target, docs)], len(single[0].keys() | single[1].keys())

    def of(i):
        t, means = docs[i], []
        own_single, own_pair = Counter(t), Counter(zip([None, *t], t, strict=False))
        for side, own in enumerate((0, 1)):
            total = sum(single[side].values()) - own * len(t) + lm_score.ADDED * (n_words + 1)
            context = lambda a: texts[side] - own if a is None else single[side][a] - own * own_single[a]  # noqa: B023, E731
            p = [0.7 * min((pair[side][a, b] - own * own_pair[a, b]) / max(1, context(a)), 1) + 0.3 * (single[side][b] - own * own_single[b] + lm_score.ADDED) / total for a, b in zip([None, *t], t, strict=False)]
            means.append(-np.mean(np.log(p)))
        return means

    return of


def test_losses_match_brute_force(spark, docs):
    target = [words_in(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {r.doc_id: r for r in queries.op8_lm_score(spark, SF).collect()}
    rows = docs.collect()
    losses = brute_losses(target, [words_in(r.text) for r in rows])
    assert len(found) == len(rows)
    for i, r in enumerate(rows):
        own = found[r.doc_id]
        assert own.n_tokens == len(words_in(r.text))
        if own.n_tokens:
            assert np.allclose([own.loss_target, own.loss_background], losses(i), atol=1e-9) and abs(own.difference - (own.loss_target - own.loss_background)) < 1e-12


def test_a_document_that_occurs_twice_is_known_to_the_background(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(80))) for i in range(200)] + [(200, None)]
    rows.append((201, rows[7][1]))
    found = {r.doc_id: r for r in lm_score.cross_entropy_difference(none_of(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[7].loss_background == found[201].loss_background < min(r.loss_background for i, r in found.items() if i not in (7, 200, 201)) - 1


def test_scores_prefer_the_target(spark):
    target = spark.createDataFrame([("red green blue " * 20,)], "text string")
    frame = spark.createDataFrame([(1, "red green blue red"), (2, "one two three four"), (3, None), (4, " "), (None, "red")], "doc_id long, text string")
    found = {r.doc_id: r for r in lm_score.cross_entropy_difference(target, frame).collect()}
    assert found[1].difference < 0 < found[2].difference and found[3].difference is None and found[4].n_tokens == 0
    assert lm_score.cross_entropy_difference(target, none_of(frame)).collect() == []
    assert lm_score.cross_entropy_difference(none_of(target), awkward(spark)).count() == awkward(spark).count()


# 9 mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values())
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix_hits_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a"] * 30 + ["b"] * 5 + ["c", "d", None, "e"])) for i in range(3000)] + [(9000, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(frame).collect()
    sizes = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.size == len((dict((i, t) for i, t, _ in rows)[r.doc_id] or "").split())
    wanted = brute_targets(sizes)
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - wanted[r.source]) < 1e-6 * max(1, r.target) and r.taken <= 3 * r.size
    assert all(abs(taken[s] - wanted[s]) <= 30 for s in sizes)
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in mixing.mix(frame.repartition(7)).collect())


def test_mix_follows_its_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 16)
    rows = [(i, "w " * (i % 17 + 1), "ab"[i % 2]) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(None, 1)], "doc_id long, quality int")
    copies = {r.doc_id: r for r in mixing.mix(frame, quality).collect()}
    for s in "ab":
        own = []
        for i, t, x in rows:
            if x == s:
                u = (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                own.append((-np.log(u) / (0.5 if i % 3 else 0.25 if i % 2 == 0 else 1.0), i, len(t.split())))
        total, target = sum(x[2] for x in own), copies[0 if s == "a" else 1].target
        epochs, before = int(target // total), 0
        for _, i, n in sorted(own):
            before += n
            assert copies[i].copies == epochs + (before - n / 2 <= target - epochs * total and target - epochs * total > 0)


def test_the_mix_delivers_what_it_takes(spark):
    """Ids that repeat, within a source and across, and rows without an id: delivered words are those that are taken."""
    rng = random.Random(17)
    rows = [(rng.choice([None, 1, 2, i]), " ".join("w" for _ in range(rng.randint(1, 9))), rng.choice("aaaab")) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, delivered = Counter(), Counter()
    for r in mixing.mix(frame).collect():
        taken[r.source, r.doc_id] += r.taken
    for r in mixing.mixed_documents(frame).collect():
        delivered[r.source, r.doc_id] += len(r.text.split())
    assert +taken == +delivered


def test_mix_awkward_rows(spark):
    frame = awkward(spark)
    assert mixing.mix(frame).count() == frame.count()
    assert mixing.mix(none_of(frame)).collect() == []
    out = mixing.mixed_documents(frame)
    assert out.columns == frame.columns and out.count() == sum(r.copies for r in mixing.mix(frame).collect())


# 10 top-k


def brute_topk(rows, every, k):
    fine = [(i, np.floor(np.float64(v) * 1024).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in fine)
    fine = [(i, np.pad(v, (0, width - len(v)))) for i, v in fine]
    found = []
    for q, v in fine:
        if q % every == 0:
            best = sorted((-int(v @ d), i) for i, d in fine if i != q)[:k]
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(found)


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.05 * rng.normal(size=8)]) for i in range(900)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(5000, None), (5001, [1.0, None]), (5002, [float("nan")] * 8), (5010, []), (5020, [0.5, 0.25]), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    found = topk.top_k(frame, 5, 10).collect()
    assert sorted(tuple(r) for r in found) == brute_topk(rows, 10, 5)


def test_topk_of_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in topk.top_k(frame).collect()] == [(0, 1, 1), (0, 2, 2)]
    assert topk.top_k(none_of(frame)).collect() == [] and topk.top_k(frame.where("vec_id > 0")).collect() == []


def clustered(rng, n=20_000):
    centres = rng.normal(size=(40, 4)) * 5000
    return (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 4)) * 20).astype(np.int64)


def test_search_prunes(monkeypatch):
    data = clustered(np.random.default_rng(1))
    seen = []
    offer = topk.Best.offer
    monkeypatch.setattr(topk.Best, "offer", lambda self, rows, scores, ids: (seen.append(scores.size), offer(self, rows, scores, ids))[1])
    topk.dual_search(topk.CoverTree(data[:300], np.arange(300)), topk.CoverTree(data, np.arange(len(data))), 10)
    assert sum(seen) < 0.5 * 300 * len(data)


def test_trees_keep_their_radii():
    """Children cover their parent's rows within a radius, which no two of their centres are nearer than, and it falls from level to level."""
    rng = np.random.default_rng(7)
    for points in (clustered(rng, 3000), (rng.normal(size=(3000, 32)) * 1000).astype(np.int64), np.ones((500, 3), np.int64)):
        tree = topk.CoverTree(points, np.arange(len(points)))
        assert sorted(tree.order.tolist()) == list(range(len(points)))
        for centre, reach, _, first, last, kids in tree.nodes:
            own = points[tree.order[first:last]].astype(float)
            assert np.isclose(reach, np.sqrt(((own - points[centre]) ** 2).sum(axis=1)).max())
            if kids:
                inner = points[[tree.nodes[i][0] for i in kids]].astype(float)
                apart = np.sqrt(((inner[:, None] - inner[None]) ** 2).sum(axis=2))
                radius = max(tree.nodes[i][1] for i in kids)
                assert radius < reach and apart[~np.eye(len(kids), dtype=bool)].min() >= radius - 1e-6 and sum(tree.nodes[i][4] - tree.nodes[i][3] for i in kids) == last - first


def test_cells_are_pruned_before_anything_is_sent(spark, monkeypatch):
    """Clustered vectors: queries meet few of the other cells, and the answers are those of brute force."""
    monkeypatch.setattr(topk, "DATA_BLOCK", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    data = clustered(np.random.default_rng(9), 6000) / 1024
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    sent = []
    searched = topk.searched
    monkeypatch.setattr(topk, "searched", lambda meetings, *rest: (sent.append(meetings.count()), searched(meetings, *rest))[1])
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect()
    assert sorted(tuple(r) for r in found) == brute_topk(rows, 50, 5)
    queries_cells = 30 * 30
    assert sum(sent) < 0.5 * queries_cells


def test_components_that_do_not_fit_take_no_part(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e9, 0.0]), (2, [1e6, 1e6]), (3, [1e300, 0.0]), (4, [-1e6, 1e6])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 100).collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 2 * 1024 * 1024 * 10**6), (4, 0)]


def test_every_word_and_pair_is_counted(spark, monkeypatch):
    """More distinct words than the former vocabulary had, and more distinct pairs than it had cells; exact to rounding, over many chunks."""
    monkeypatch.setattr(lm_score, "CHUNK", 1 << 16)
    rng = random.Random(21)
    rows = [(i, " ".join(f"w{rng.randrange(400_000)}" for _ in range(3_000))) for i in range(450)] + [(450, ""), (None, None)]
    target = [" ".join(rows[i][1].split()[:500]) for i in range(5)]
    found = {r.doc_id: r for r in lm_score.cross_entropy_difference(spark.createDataFrame([(t,) for t in target], "text string"), spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    sides = [[t.split() for t in target], [(t or "").split() for _, t in rows]]
    assert len({w for side in sides for t in side for w in t}) > 1 << 16 and len({p for t in sides[1] for p in zip(t[:-1], t[1:], strict=True)}) > 1 << 20
    losses = brute_losses(*sides)
    for i in (0, 4, 5, 449):
        assert np.allclose([found[i].loss_target, found[i].loss_background], losses(i), atol=1e-9)
    assert found[450].n_tokens == 0 and found[450].difference is None and found[None].n_tokens == 0


# SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages", "benchmark"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, wanted = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    text = lambda frame: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))
    assert text(found) == text(wanted)


def test_pipeline_matches_its_stages_by_brute_force(spark, docs):
    model = queries.toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.toxic_sentences(docs, model).collect() if r.score >= corpus_pipeline.TOXIC_FROM}
    kept = {r.doc_id: r for r in docs.collect() if r.doc_id not in bad}
    keep = {min(v)[2] for v in brute_exact([(i, r.text) for i, r in kept.items()]).values()}
    near = brute_near([(i, r.text) for i, r in kept.items() if i in keep], 80)
    last = {i for i, (_, label, _) in near.items() if label == i}
    mixed = {r.doc_id: r.copies for r in mixing.mix(docs.where(F.col("doc_id").isin(list(last))), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in found) == {i: n for i, n in mixed.items() if n}
    assert all(r.ids == sp.encode(kept[r.doc_id].text or "", add_eos=True) and r.n_tokens == len(r.ids) and r.decoded == sp.decode(r.ids) for r in found)


def test_stages_keep_the_columns_of_documents(spark):
    frame = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        assert stage(spark, none_of(frame), SF).collect() == []


def test_stages_judge_rows_of_null_and_reused_ids_by_their_own_text(spark, monkeypatch):
    """One toxic row or near copy takes no clean, unique row along that shares its id or has none either."""
    own = lambda name: " ".join(f"{name}w{k}" for k in range(150))
    near = own("n").replace("nw70 ", "other ")
    rows = [(None, own("a")), (None, own("n")), (None, near), (7, own("b")), (7, own("c")), (7, own("c").replace("cw70 ", "x ")), (8, own("m")), (9, own("e")), (9, own("m").replace("mw70 ", "x "))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_one_of_each(frame).collect()]
    assert {rows[i] for i in (0, 3, 6, 7)} < set(kept) and rows[8] not in kept and len(kept) == 6
    bad = [(None, "beastly. " * 3), (7, "so beastly")]
    feature = toxicity.instances(*toxicity.flat_text(pa.array(["beastly"])))[0][-1]
    weights = np.zeros(toxicity.FEATURES)
    weights[feature] = 20
    monkeypatch.setattr(queries, "toxicity_model", lambda docs, labels: toxicity.ToxicityModel(weights, -10.0))
    found = corpus_pipeline.without_toxic(spark, spark.createDataFrame(rows + bad, "doc_id long, text string"), SF).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)


def test_lm_rows_grow_as_the_corpus(spark, monkeypatch):
    """A fourfold corpus sends four times the rows, however many chunks it has; and a chunk never sends more rows than it has keys."""
    monkeypatch.setattr(lm_score, "CHUNK", 64)
    rng, sent = random.Random(8), []
    for n in (400, 1600):
        texts = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(40)), False) for i in range(n)]
        chunks = lm_score.chunked(spark.createDataFrame(texts, "doc_id long, text string, in_target boolean").coalesce(2)).cache()
        bins = 1 << (chunks.count() - 1).bit_length()
        rows = lm_score.keyed(chunks, bins).selectExpr("chunk", "length(keys) as size").cache()
        sent.append(rows.count())
        assert rows.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 2 * (64 + 41)
    assert sent[1] < 5 * sent[0]


# 11 vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd over all rows one by one, in Python's integers."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, _, v in kept]
    as_bytes = lambda x: struct.pack(f"<{len(x)}{'h' if max(map(abs, x)) < 1 << 15 else 'i'}", *x)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [as_bytes(x) for x in cut[k]]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            near = [best(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, e in zip(cut, near, strict=True) if e == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found, by_label = [], Counter()
    for (i, label, _), c in zip(kept, cut, strict=True):
        near = [best(x, book) for x, book in zip(c, books, strict=True)]
        found.append((i, label, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near)))
        by_label[label] += found[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label]) for i, label, c, e in found), key=str), digest


def test_vector_codes_match_brute_force(spark):
    rng = random.Random(11)
    near = [round(rng.gauss(0, 0.2), 3) for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in near] if i % 3 else near, i % 4 or None) for i in range(60)]
    rows += [(60, None, 1), (61, [0.1] * 7 + [None], 1), (62, [0.1] * 7 + [float("nan")], 2), (63, [float("-inf")] + [0.1] * 7, 2), rows[5], rows[5], (None, near, 3), (7, [90.0] * 8, 3), (64, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for entries in (5, 256):
        found, model = vector_codes.compressed(frame, entries=entries)
        wanted, digest = brute_codes(rows, entries=entries)
        assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in found.collect()], key=str) == wanted
        assert model.digest == digest


def test_vector_codes_are_exact_beyond_what_a_double_holds(spark):
    rows = [(i, [x * 6_003.25 + i % 3, -x * 7.5, 0.25, 1e5 * (i % 3)], None) for i, x in enumerate(range(40))]
    found, model = vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=6)
    wanted, digest = brute_codes(rows, entries=6)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in found.collect()], key=str) == wanted and model.digest == digest
    values = np.array([[1 << 29, -(1 << 29)], [5, 6]])
    assert vector_codes.nearest(values, np.array([[1 << 29, 1 - (1 << 29)], [1 << 29, -(1 << 29)], [5, 6], [5, 6]]))[0].tolist() == [1, 2]
    assert (vector_codes.unpacked(vector_codes.packed(values), 2) == values).all()


def test_vector_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label string, code int, error string, row int, part int, parts string"
    none = spark.createDataFrame([], schema)
    found, model = vector_codes.compressed(none)
    assert found.count() == 0 and model.digest == hashlib.sha256(b"").hexdigest() and found.columns == ["vec_id", "label", "code", "error", "label_error"]
    rows = [(1, [1.0, 2.0, 3.0, 4.0], None, 1, "x", 1, 1, "y"), (2, [1.0, 2.0, 3.0], "a", 1, "x", 1, 1, "y"), (3, [1e30, 0.0, 0.0, 0.0], "a", 1, "x", 1, 1, "y"), (4, [1.0] * 8, "a", 1, "x", 1, 1, "y"), (5, [0.0] * 4, "b", 1, "x", 1, 1, "y")]
    found = {r.vec_id: (r.code, r.error, r.label, r.label_error) for r in vector_codes.compressed(spark.createDataFrame(rows, schema))[0].collect()}
    assert found == {1: ("00000000", 0, None, 0), 5: ("01010101", 0, "b", 0)}


# 12 phrases


def brute_collocations(rows, least, longest, percent, top):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    found = []
    for lang, f in counts.items():
        own = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in own.items():
            score, _, left, right = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            inside = any(len(h) > len(g) and 100 * b >= percent * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in own.items())
            if not inside:
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        found += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(found)


def collocation_rows(frame, **kwargs):
    return sorted(tuple(r) for r in phrases.collocations(frame, **kwargs).collect())


@pytest.mark.parametrize("width", [8, 12, None])
def test_collocations_match_brute_force(spark, monkeypatch, width):
    """At any width of the sketch, even one that lets nearly all through, with texts over many slices and tasks."""
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "TOUCHED", 100)
    rng = random.Random(12)
    names = ["new york city", "New York", "zürich see", "ab cd ef gh", "x"]
    texts = [(" ".join(rng.choice([*names, "foo", "bar", "\t", "a.b", "no,no", "Ö", "\U0001f600"]) for _ in range(rng.randrange(60))) + rng.choice(["", "\n", " !"]), rng.choice(["en", "de", None, "und", ""])) for _ in range(120)]
    texts += [(None, "en"), ("", None), ("solo", "xx"), ("ha " * 3000, "hot"), *[texts[0]] * 5]
    frame = spark.createDataFrame(texts, "text string, lang string").repartition(5)
    for longest, percent, top in ((3, 50, 2000), (4, 50, 7), (2, 90, 3)):
        assert collocation_rows(frame, longest=longest, subsumed_percent=percent, top=top, width=width) == brute_collocations(texts, 10, longest, percent, top)


def test_collocations_of_awkward_tables(spark):
    frame = awkward(spark).withColumns({"phrase": F.lit(1), "a": F.lit("x"), "size": F.lit(None), "n": F.lit(2)})
    wanted = brute_collocations([(r.text, r.lang) for r in frame.select("text", "lang").collect()], 2, 3, 50, 2000)
    assert wanted and collocation_rows(frame, least=2) == wanted
    assert collocation_rows(none_of(frame)) == []


def test_collocation_scores_pass_64_bits(spark):
    """Counts of billions: scored from a table of counts."""
    a = 4_000_000_000
    assert 1_000_000 * a * a > 1 << 63
    row = spark.sql(f"select cast({a} as decimal(19,0)) * cast({a} as decimal(19,0)) * cast(1000000 as decimal(7,0)) div (cast({a + 1} as decimal(19,0)) * cast({a + 7} as decimal(19,0))) as s").first()
    assert row.s == 1_000_000 * a * a // ((a + 1) * (a + 7))


def test_sketch_never_counts_less_than_there_is(spark):
    words = [(f"w{i % 50} w{i % 7}", "en") for i in range(700)]
    frame = spark.createDataFrame(words, "text string, lang string").repartition(3)
    for width in (4, 10):
        found = {r.phrase: r.f for r in phrases.phrase_counts(frame, width=width).where("size > 0").collect()}
        true = Counter(x for t, _ in words for x in (t, *t.split()))
        assert found == {k: v for k, v in true.items() if v >= 10}


# 13 licences


def brute_licenses(text):
    words = licenses.words_of(text or "")
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_phrases_match_brute_force(spark):
    rng = random.Random(13)
    bits = ["MIT", "License", "license", "CC", "BY", "by", "cc", "gnu", "General", "public", "GNU general PUBLIC license", "apache", "-", "\n", "x", "é", "mit-license", "licenseé", "1", "_", "\U0001f600"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(80))) for _ in range(300)] + ["", None, "cc by " * 4000, "mit license"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "cc by")], "doc_id long, text string")
    for r in licenses.license_matches(frame).collect():
        text = "cc by" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == brute_licenses(text)
        assert set(r.base_labels) <= set(r.labels) and (r.score == 1.0 if r.n_base else 0 <= r.score <= 1)


def test_license_notices_are_found_where_they_stand(spark):
    """Every notice in a long text with words changed, left out and put in; none in texts that only share their words."""
    rng = random.Random(31)
    filler = "lorem the software of this is provided any copy and use for in source forms".split()
    rows, wanted = [], {}
    for k, (label, text, keys) in enumerate(licenses.TEMPLATES):
        words = text.split()
        before, after = ([rng.choice(filler) for _ in range(rng.randrange(2000))] for _ in range(2))
        rows.append((k, " ".join(["# Copyright 2020 Someone", *before, *words, *after])))
        wanted[k] = (label, len(licenses.words_of(" ".join(before))) + 4)
        shuffled = licenses.words_of(text)
        rng.shuffle(shuffled)
        rows.append((100 + k, " ".join(shuffled)))
        rows.append((200 + k, " ".join(w for w in licenses.words_of(text) if w not in licenses.words_of(keys[0])[:2])))
    found = {r.doc_id: r for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, at) in wanted.items():
        own = [m for m in found[k].matches if m.label == label and abs(m.first - at) <= 4]
        assert own and max(m.score for m in own) == 1.0, (k, label, found[k].matches)
        assert not found[100 + k].matches
        if [x for x, _, _ in licenses.TEMPLATES].count(label) == 1:
            assert label not in [m.label for m in found[200 + k].matches]
    mit = licenses.TEMPLATES[0][1].replace("Software", "Program", 1).replace("IN NO EVENT SHALL THE AUTHORS", "IN NO CASE WILL WE")
    one = licenses.license_matches(spark.createDataFrame([(1, "/* " + mit + " */")], "doc_id long, text string")).first()
    assert one.labels == ["mit"] and 0.8 < one.score < 1


def test_licenses_of_awkward_tables(spark):
    frame = awkward(spark).withColumns({"labels": F.lit(1), "matches": F.lit("x"), "n_words": F.lit(None)})
    found = licenses.license_matches(frame)
    assert found.count() == frame.count() and licenses.license_matches(none_of(frame)).count() == 0
    assert {(r.n_base, r.score) for r in found.collect()} == {(0, 0.0)}


def test_new_queries_run_and_equal_their_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "embeddings"):
        duck.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name in ("op11_vector_codes", "op12_collocations"):
        found, sql = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(sql.columns)
        assert sorted(found[sorted(found)].itertuples(index=False, name=None)) == sorted(sql[sorted(found)].itertuples(index=False, name=None))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13_license_scan(spark, SF).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id])
