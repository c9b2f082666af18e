"""The training-data operators on small hand-made tables, against plain-Python versions."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from sward.llm import decontaminate, language, language_model, merkle, near_duplicates, packing, pii, quality, shards, toxicity
from sward.llm.common import Memo, ship
from sward.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s0", len(t or ""), 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [None, "", "   \n ", "a", "a", "word " * 3000, "12 34 !! @@ +1"]


def test_windows_agree_with_brute_force(spark):
    rng = random.Random(1)
    items = [words(rng, n, 12) for n in (30, 25, 14, 10, 4, 1)] + [None, "", "W1 w2, W3"]
    texts = [words(rng, 60, 12) for _ in range(60)] + [f"x {items[0]} y {items[2]}", items[1].upper(), "w1-w2.w3", *EDGE]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    for block in (50_000, 8):
        got = {r.doc_id: r for r in decontaminate.digest(decontaminate.find_spans(docs_of(spark, texts), bench, block_words=block)).collect()}
        for i, t in enumerate(texts):
            w, hit, who = tokens(t), set(), set()
            for k, item in enumerate(items):
                own = tokens(item)
                m = min(10, len(own))
                windows = {tuple(own[j : j + m]) for j in range(len(own) - m + 1)} if own else set()
                for j in range(len(w) - m + 1):
                    if m and tuple(w[j : j + m]) in windows:
                        hit.update(range(j, j + m))
                        who.add(str(k))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(who))
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()


def test_passages_are_cut_and_clean_texts_stay(spark):
    rng = random.Random(2)
    item = words(rng, 20, 10_000)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = words(rng, 50, 10_000)
    texts = [clean, f"{clean} {item}! {clean}", item, *EDGE]
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs_of(spark, texts), bench).collect()}
    assert got[0] == clean and got[1] == f"{clean} ! {clean}" and 2 not in got
    assert [got[i + 3] for i in range(len(EDGE))] == EDGE
    assert decontaminate.decontaminate(docs_of(spark, []), bench).count() == 0


def test_cuts_do_not_depend_on_the_blocks(spark):
    rng = random.Random(12)
    long = [f"p{i}" for i in range(2000)]
    items = [" ".join(long[i : i + 21]) for i in range(0, 1900, 15)] + ["p7 p8 p9", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = list(EDGE)
    for _ in range(40):
        at, n = rng.randrange(1800), rng.randrange(5, 80)
        texts.append(f"{words(rng, rng.randrange(60))}! {' '.join(long[at : at + n])}. {words(rng, rng.randrange(30))}")
    inner = long[300:321]
    texts.append(" ".join(inner[:9] + long[600:621] + inner[9:] + ["end"] * 60))  # whole again once the middle is cut
    for max_length, max_coverage in ((1, 0.8), (15, 0.5)):
        one, many = (
            {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(docs_of(spark, texts), bench, max_length=max_length, max_coverage=max_coverage, block_words=b).collect()}
            for b in (50_000, 400)
        )
        assert one == many and 0 < len(one) < len(texts)
    few = spark.createDataFrame(list(enumerate(items[:4])), "item_id long, text string")
    rows = docs_of(spark, [*texts, " ".join(long[:40] + ["end"] * 9)])
    one, many = ({r.doc_id: r.text for r in decontaminate.decontaminate(rows, few, block_words=b).collect()} for b in (50_000, 8))
    assert one == many
    assert decontaminate.decontaminate(docs_of(spark, []), bench, block_words=400).count() == 0


def test_language_is_learned(spark):
    rng = random.Random(3)
    pool = {"aa": "abcde", "bb": "vwxyz"}
    texts, langs = [], []
    for _ in range(120):
        lang = rng.choice(sorted(pool))
        texts.append(" ".join("".join(rng.choices(pool[lang], k=5)) for _ in range(20)))
        langs.append(lang)
    model = language.train(docs_of(spark, texts, langs))
    assert (model.weights == 0).mean() > 0.5
    found = language.identify(docs_of(spark, [*texts, *EDGE], [*langs, *[None] * len(EDGE)]), model, ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang for r in found if r.lang) and all(0 <= r.score <= 1 for r in found)
    assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)[120:123]] == ["und"] * 3
    assert language.train(docs_of(spark, [])).predict("abc") == ("und", 0.0)


def test_toxic_words_are_learned(spark):
    rng = random.Random(4)
    texts = [words(rng, 40, 300) + (f" {rng.choice(['vile', 'nasty'])} " + words(rng, 5, 300) if i % 3 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(500)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of(spark, texts), labels)
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, [*texts, *EDGE]), model, ["doc_id"]).collect()}
    assert sum(got[i].predicted == int(i % 3 == 0) for i in range(500, 600)) >= 95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and len(got) == 607
    none = toxicity.train(docs_of(spark, []), labels.limit(0))
    assert toxicity.score(docs_of(spark, EDGE), none, ["doc_id"]).count() == len(EDGE)


def test_trees_learn_and_flat_traversal_agrees(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.grow(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95

    def walk(row):
        total = model.base
        for f, c, leaf in zip(model.features, model.cuts, model.leaves, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > c[k])
            total += leaf[k - len(f)]
        return total

    assert model.margin(x[:20]) == pytest.approx([walk(r) for r in x[:20]])
    assert quality.score(docs_of(spark, EDGE), model, ["doc_id"]).count() == len(EDGE)
    assert quality.accepted(docs_of(spark, []), model).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_spans_agree_with_the_patterns():
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choices("aé@@..-+ (12093%_", k=rng.randrange(60)))
        t += rng.choice(["", " 4111 1111-1111 1111", " +1 (555) 123-4567", " 1.2.3.255", " a.b@c-d.e.f@g.h"])
        want = {k: [m.span() for m in re.finditer(p, t)] for k, p in PATTERNS.items()}
        digits = lambda a, b: [int(c) for c in t[a:b] if c.isdigit()]  # noqa: B023, E731
        luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
        want["ip"] = [s for s in want["ip"] if all(int(x) <= 255 for x in t[slice(*s)].split("."))]
        want["card"] = [s for s in want["card"] if 16 <= len(digits(*s)) <= 19 and luhn(digits(*s))]
        want["phone"] = [s for s in want["phone"] if 8 <= len(digits(*s)) <= 15]
        assert pii.base_spans(t) == want, t


def test_patterns_find_unseen_identifiers(spark):
    seeds = [f"please dial +1 555 010 {i:04d} today" for i in range(8)]
    texts = [*seeds, "please dial (555) 010-7777 today", "version 2.0 of it", *EDGE]
    found = {r.doc_id: r for r in pii.digest(pii.extract(docs_of(spark, texts))).collect()}
    assert found[8].spans == "phone:12:26" and found[8].n_phone == 0 and found[9].spans == ""
    assert found[0].spans == "phone:12:27" and len(found) == len(texts)
    hidden = {r.doc_id: r.text for r in pii.redact(docs_of(spark, texts)).collect()}
    assert hidden[8] == "please dial <PHONE> today" and hidden[0] == "please dial <PHONE> today" and hidden[9] == texts[9]
    assert pii.extract(docs_of(spark, [])).count() == 0


def test_merged_identifiers_are_candidates(spark):
    def others(text):
        return {(k, text[a:b]) for k, a, b, seed in pii.candidates(text, pii.base_spans(text)) if not seed}

    cards = ["7536784127813050 4845168114407329", "2353820953013749 4550997810720808"]  # documents 46 and 1262 of sf0.1
    for pair in cards:
        assert {("card", c) for c in pair.split()} == others(f"w {pair} w")
    assert {("card", c) for c in cards[0].split()} == others(f"w {cards[0].replace(' ', '-')} w")
    assert {("card", "4111 1111 1111 1111"), ("card", "5500 0000 0000 0004")} <= others("w 4111 1111 1111 1111 5500 0000 0000 0004 w")
    for phone, ip in (("+1 (826) 555-4081", "190.137.223.204"), ("+1 (843) 555-7672", "170.106.47.218")):  # 1377 and 7052
        assert others(f"w {phone} {ip} w") == {("phone", phone)} and others(f"w {ip} {phone} w") == set()
    assert ("phone", "8265554081") in others("w 8265554081 w") and ("phone", "826.555.4081") in others("w 826.555.4081 w")
    assert ("phone", "826 555 4081") in others("w 826 555 4081 w") and ("ip", "300.1.2.300") in others("w 300.1.2.300 w")
    assert ("email", "bob@localhost") in others("w bob@localhost,ann@x.com w") and ("phone", "8265554081") in others("w 8265554081 12th w")

    seeds = [f"charge card {n} expires soon" for n in range(4000000000000000, 4000000000000400) if pii.base_spans(f" {n} ")["card"]][:20]
    seeds += [f"please dial +1 555 010 {i:04d} right now" for i in range(20)]
    texts = [*seeds, f"charge card {cards[0]} expires soon", "please dial +1 (826) 555-4081 190.137.223.204 right now", "please dial 8265554081 right now"]
    found = {r.doc_id: r.spans for r in pii.digest(pii.extract(docs_of(spark, texts))).collect()}
    assert found[40] == "card:12:28,card:29:45" and found[41] == "ip:30:45,phone:12:29" and found[42] == "phone:12:22"


def test_slots_move_only_to_the_new_shard(spark, tmp_path):
    own = shards.initial_map(7, 512)
    more = shards.grown_map(own)
    assert all(a == b or b == 7 for a, b in zip(own, more, strict=True)) and max(Counter(more).values()) - min(Counter(more).values()) <= 2
    load = {s: 1000 * (s % 5 == 0) + s for s in range(512)}
    after = shards.rebalanced_map(own, load)
    total = lambda m: [sum(load[s] for s in range(512) if m[s] == k) for k in range(7)]
    assert max(total(after)) <= 1.05 * sum(load.values()) / 7 or max(total(after)) < max(total(own))
    folder = str(tmp_path / "map")
    for version, m in ((1, own), (2, more)):
        shards.store_map(shards.map_table(spark, m, version), folder)
    assert shards.load_map(spark, folder) == more and shards.load_map(spark, folder, 1) == own
    rows = shards.place(docs_of(spark, [*EDGE, *[str(i) for i in range(200)]]), 5).collect()
    for k in range(5):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 5) for r in rows) and rows[0].text_crc32 is not None
    assert next(r for r in rows if r.doc_id == 3).text_crc32 == zlib.crc32(b"a")


def brute_groups(texts, k=2, limit=80):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= limit * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return [len(s) for s in sets], root


def test_smallest_sets_are_not_missed():
    rng = np.random.default_rng(31)
    n = 20_000
    two = [np.sort(rng.integers(0, 1 << 64, 5, np.uint64)) for _ in range(n)]
    one = [np.delete(s, rng.integers(5)) for s in two]  # four of five shingles: at the limit itself
    a, b = (np.array([near_duplicates.signature(s) for s in own]) for own in (one, two))
    (ra, ka), (rb, kb) = near_duplicates.band_keys(a, np.full(n, 4), 0.8), near_duplicates.band_keys(b, np.full(n, 5), 0.8)
    met = {r for r, _ in set(zip(ra.tolist(), ka.tolist(), strict=True)) & set(zip(rb.tolist(), kb.tolist(), strict=True))}
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), *[pa.array([x.tobytes() for x in s]) for s in (a, b)]], names=["a", "b", "sa", "sb"])
    likely = sum(x.num_rows for x in near_duplicates._likely(0.8)([batch]))
    assert len(met) == n and likely == n


@pytest.mark.parametrize("crowded", [24, 2])
def test_groups_agree_with_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_duplicates, "CROWDED", crowded)
    rng = random.Random(7)
    texts = list(EDGE)
    for n in (1, 2, 3, 5, 8, 12, 20, 40, 90, 200):
        base = [f"v{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(1 + n // 9)):
                copy[rng.randrange(n)] = f"u{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    passage = words(rng, 60, 10_000)
    texts += [f"{passage} {words(rng, 50, 10_000)}" for _ in range(30)]
    sizes, root = brute_groups(texts)
    got = {r.doc_id: r for r in near_duplicates.groups(docs_of(spark, texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == list(zip(sizes, root, strict=True))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert near_duplicates.groups(docs_of(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    docs = docs_of(spark, ["a b c d e f g h", "a b c d e f g h", "x y", None, ""])
    docs = docs.unionByName(docs.where("doc_id = 2"))
    kept = near_duplicates.without_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and kept.columns == docs.columns



def test_copies_go_by_row_not_by_key(spark):
    rng = random.Random(21)
    base = [words(rng, 30, 10_000) for _ in range(8)]
    near = [f"{base[5]} z{i}" for i in range(4)]
    rows = [(3, base[0]), (None, base[0]), (None, base[1]), (None, base[2]), (None, base[2]), (None, None), (None, "")]
    rows += [(9, base[3]), (7, base[3]), (9, base[4]), (9, f"{base[4]} z")]
    rows += [*[(11, t) for t in near], *[(None, f"{base[6]} z{i}") for i in range(4)]]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), 0.5, "x") for k, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in near_duplicates.without_copies(docs).collect())
    assert max(got.values()) == 1 and near_duplicates.without_copies(docs).columns == docs.columns
    assert {(3, base[0]), (None, base[1]), (None, base[2]), (None, None), (None, ""), (7, base[3])} <= set(got)
    assert (None, base[0]) not in got and (9, base[3]) not in got
    assert [sum(k == key and (t or "").startswith(b) for k, t in got) for key, b in ((9, base[4]), (11, base[5]), (None, base[6]))] == [1, 1, 1]
    assert len(got) == 9


def test_estimate_is_close():
    memo = near_duplicates.word_hashes()
    rng = random.Random(8)
    a = [f"q{rng.randrange(10**6)}" for _ in range(3000)]
    b = a[:2400] + [f"z{i}" for i in range(600)]
    x, y = (near_duplicates.shingle_set(" ".join(w).encode(), 1, memo) for w in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    near = near_duplicates.estimate(*(near_duplicates.signature(s)[None] for s in (x, y)))[0]
    assert near == pytest.approx(true, abs=0.12)


def plain_context_tree(learnt, asked):
    """log10 of the probabilities of whole texts under context-tree weighting, node by node."""
    depth = language_model.DEPTH
    nodes, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def steps(text):
        data = [10] * depth + list(language_model.symbols(text).tolist())
        for i in range(depth, len(data)):
            context = tuple(data[i - d] for d in range(1, depth + 1))
            bits = f"{data[i]:08b}"
            yield [(context, bits[:k], int(bits[k])) for k in range(8)]

    for text in learnt:
        for decisions in steps(text):
            for context, seen, bit in decisions:
                for d in range(depth + 1):
                    nodes[context[:d], seen][bit] += 1
                    if d:
                        children[context[: d - 1], seen].add(context[:d])

    @functools.cache
    def weight(context, seen):
        a, b = nodes.get((context, seen), (0, 0))
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == depth:
            return own, own
        return own, np.logaddexp(own, sum(weight(c, seen)[1] for c in children[context, seen])) - math.log(2)

    def one(context, seen):
        spent, left, mixed = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            a, b = nodes.get((context[:d], seen), (0, 0))
            if a + b == 0:
                break
            kt = (b + 0.5) / (a + b + 1)
            mixed = spent + left * kt
            own, both = weight(context[:d], seen)
            share = math.exp(own - math.log(2) - both) if d < depth else 1
            spent, left = spent + left * share * kt, left * (1 - share)
        return mixed

    return [sum(math.log10(one(c, s) if bit else 1 - one(c, s)) for decisions in steps(t) for c, s, bit in decisions) for t in asked]


@pytest.mark.parametrize("most", [language_model.GRAMS, 40])
def test_language_model_against_plain_counts(spark, monkeypatch, most):
    monkeypatch.setattr(language_model, "GRAMS", most)  # with few pairs at hand, the others come by the join
    rng = random.Random(9)
    texts = [words(rng, rng.randrange(1, 40), 50).title() for _ in range(60)] + EDGE
    docs = docs_of(spark, texts)
    model = language_model.train(docs, F.col("doc_id") < 50)
    tokens = [(t or "").lower().split() + ["\n"] for t in texts]
    counts = Counter(w for t in tokens[:50] for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = plain_context_tree([(t or "").encode() for t in texts[:50]], [(t or "").encode() for t in texts])
    for r in language_model.score(docs, model).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
        assert r.score == pytest.approx(expected[r.doc_id], rel=1e-7)
    blank = language_model.train(docs, F.lit(False))
    assert all(r.score == pytest.approx(8 * math.log10(0.5) * len(language_model.symbols((texts[r.doc_id] or "").encode()))) for r in language_model.score(docs, blank).collect())
    none = docs.limit(0)
    assert language_model.score(none, language_model.train(none, F.lit(True))).count() == 0


def test_one_context_tree_by_hand():
    """With depth 0 alone the tree is the plain KT estimate of each decision."""
    counts = np.zeros((1, 256))
    counts[0, 97], counts[0, 98] = 3, 1
    logs = language_model._byte_logs(np.nan_to_num(language_model.own_estimate(counts), nan=0.5))
    seven_common = (4.5 / 5) ** 6  # 'a' = 0110 0001 and 'b' = 0110 0010 share six decisions
    assert 10 ** logs[0, 97] == pytest.approx(seven_common * (3.5 / 5) * (3.5 / 4), rel=1e-5)
    assert (10**logs).sum() == pytest.approx(1)


def test_a_sliced_subtree_is_the_whole_one(monkeypatch):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(97, 101, (4000, 4)) @ (1 << 8 * np.arange(4))) + (7 << 40) + (8 << 32)
    n = rng.integers(0, 5, len(keys))
    above = (np.full((1, 256), 0.4), np.full((1, 256), 0.1), np.full((1, 256), 0.7))
    whole = language_model.subtree_logs(keys, n, *above)
    monkeypatch.setattr(language_model, "SLICE", 5)
    assert np.allclose(language_model.subtree_logs(keys, n, *above), whole)


def test_bins_hold_no_conflicts(spark):
    rng = random.Random(10)
    texts = [*EDGE, *[words(rng, rng.randrange(1, 400), 9) for _ in range(300)], *["same text"] * 40]
    docs = docs_of(spark, texts, sources=[f"s{rng.randrange(6)}" if rng.random() < 0.9 else None for _ in texts])
    rows = packing.pack(docs, capacity=1000, cell=150).collect()
    length, source = {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}, {r.doc_id: r.source for r in docs.collect()}
    bins, whole = {}, Counter()
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        whole[r.doc_id] += r.length
    assert whole == length
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))] and held[-1].bin_offset + held[-1].length <= 1000
        for marks in ([source[r.doc_id] for r in held], [texts[r.doc_id] for r in held]):
            marks = [m for m in marks if m is not None]
            assert len(marks) == len(set(marks))
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_free_bin():
    placed = packing.best_fit([(6, "a", 1), (5, "b", 2), (4, "a", 3), (4, "c", 3), (1, "b", 4)], 10)
    assert placed == [(0, 0), (1, 0), (1, 5), (0, 6), (2, 0)]


def test_fingerprints_locate_edits(spark):
    texts = ["One. Two.\nThree.\n\nFour.", "One. Two.\nThree!\n\nFour.", None, "x" * 5000, "", "One. Two.\nThree.\n\nFour."]
    rows = {r.doc_id: r for r in merkle.compare_edits(docs_of(spark, texts)).collect()}
    assert rows[0].fingerprint == rows[5].fingerprint != rows[1].fingerprint and rows[2].fingerprint == rows[4].fingerprint
    cut = texts[1][:12] + texts[0][:11]
    assert rows[1].edited_sha256 == hashlib.sha256(cut.encode()).hexdigest() and rows[1].n_chars == 23
    pair = spark.createDataFrame([(rows[0].fingerprint, rows[1].fingerprint)], "a string, b string")
    assert [tuple(d) for d in pair.select(merkle.differing("a", "b").alias("d")).first().d] == [(0, 2)]
    assert 0 < rows[1].near_next < 1 and merkle.compare_edits(docs_of(spark, [])).count() == 0


def test_memo_stays_bounded():
    memo = Memo(len, limit=3)
    assert [memo["x" * i] for i in range(9)] == list(range(9)) and len(memo) <= 3


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, sf_dir):
    ok, note = compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])
    assert ok, note


def test_pipeline_stages_agree_with_plain_versions(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    _, root = brute_groups([r.text for r in rows], k=5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[i].doc_id for i in root})
    clean = corpus_pipeline.hide_personal_data(spark, corpus_pipeline.drop_benchmark_passages(spark, kept, sf_dir), sf_dir)
    assert clean.columns == docs.columns
    assert decontaminate.digest(decontaminate.find_spans(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).where("contaminated").count() == 0
    assert all(not any(pii.base_spans(r.text).values()) for r in clean.collect())


def test_sketches_of_linked_sets_are_alike(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in [1, 3, 4, 5, 9, 12, 20, 40, 150, 400, 3000] * 60:
        union = rng.integers(0, 1 << 63, max(n, 1)).astype(np.uint64)
        differ = rng.permutation(len(union))[: len(union) // 5]  # the most that a linked pair can differ in
        cut = rng.integers(0, len(differ) + 1)
        sets = [np.sort(np.delete(union, differ[:cut])), np.sort(np.delete(union, differ[cut:]))]
        bits = near_duplicates.sketch(np.stack([near_duplicates.signature(s) for s in sets]))
        rows.append((len(sets[0]), len(sets[1]), *map(int, bits[0]), *map(int, bits[1])))
    names = ["na", "nb", *[f"{c}a" for c in near_duplicates.BITS], *[f"{c}b" for c in near_duplicates.BITS]]
    assert spark.createDataFrame(rows, names).where(near_duplicates.alike(0.8)).count() == len(rows)


def test_pairs_with_too_many_different_registers_are_left_out():
    rng = np.random.default_rng(5)
    rows = []
    for differ in (2, 12):  # of 20 shingles each: linked, and far from it, though both use few registers
        union = rng.integers(0, 1 << 63, 20 + differ // 2).astype(np.uint64)
        rows.append([np.sort(union[:20]), np.sort(union[differ // 2 :])])
    signs = [pa.array([near_duplicates.signature(r[i]).tobytes() for r in rows]) for i in (0, 1)]
    ids, sizes = pa.array([0, 1]), pa.array([20, 20])
    batch = pa.RecordBatch.from_arrays([ids, ids, *signs, sizes, sizes], names=["a", "b", "sa", "sb", "na", "nb"])
    assert [x for out in near_duplicates._likely(0.8)([batch]) for x in out.column("a").to_pylist()] == [0]


def test_copies_that_are_linked_only_through_their_source(spark):
    rng = random.Random(15)
    source = [f"s{i}" for i in range(400)]
    texts = [" ".join(source)]
    for _ in range(60):  # each near the source, no two of them near each other
        own = list(source)
        for i in rng.sample(range(400), 20):
            own[i] = f"x{rng.random()}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    got = near_duplicates.groups(docs_of(spark, texts)).collect()
    assert {r.component_id for r in got} == {0}


def test_toxicity_learns_from_every_labelled_row_and_whole_texts(spark, monkeypatch):
    rng = random.Random(31)
    # the only sign of a rare group: one text of 20,500 words, its word at the end, among rows of which 2,000 were drawn
    texts = [words(rng, 6, 300) + (f" vile{i % 5}" if i % 2 else "") for i in range(9000)]
    texts[1] = words(rng, 20_500, 300) + " vile1"
    labels = spark.createDataFrame([(i, i % 2) for i in range(9000)], "doc_id long, toxic int")
    rows = toxicity.labelled_words(docs_of(spark, texts), labels, "doc_id", 23).collect()
    assert len(rows) == 9000 and max(len(r.ids) // 4 for r in rows) == 20_501
    assert {r.part for r in rows} == {toxicity.HELD, *range(toxicity.STRIPES)}
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, sizes, ids, n, toxic: seen.append((sizes, dict(zip(ids, n, strict=True)))) or fit(rows, sizes, ids, n, toxic))
    model = toxicity.train(docs_of(spark, texts), labels)
    sizes, counts = seen[0]
    held = [t for t, r in zip(texts, rows, strict=False) if r.part == toxicity.HELD]
    assert sum(sizes.values()) == 9000 and sum(c for (part, _), c in sizes.items() if part == toxicity.HELD) == len(held)
    train_rows = [r for r in rows if r.part != toxicity.HELD]
    for w in (b"vile1", b"vile3"):
        assert counts[toxicity.bucket(w)] == sum(toxicity.bucket(w) in np.frombuffer(r.ids, np.int32) for r in train_rows)
    got = toxicity.score(docs_of(spark, ["calm words", words(rng, 30_000, 300) + " vile3"]), model, ["doc_id"]).collect()
    assert [r.predicted for r in sorted(got)] == [0, 1]


def test_toxicity_gradient_and_long_texts(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [rng.integers(1, 400, n).astype(np.int32) for n in (0, 1, 2, 40, 700, 5)]
    emb = np.zeros((toxicity.BUCKETS, toxicity.DIM), np.float32)
    emb[1:400] = rng.normal(0, 1, (399, toxicity.DIM))
    model = toxicity.untrained(emb, rng)
    whole = model.peaks(texts)
    alone = [model.raw([t])[0][0] for t in texts]
    assert np.allclose(model.raw(texts)[0], alone, atol=1e-6) and np.allclose(model.raw(texts[::-1])[0], alone[::-1], atol=1e-6)
    monkeypatch.setattr(toxicity, "STRETCH", 64)
    monkeypatch.setattr(toxicity.stretches, "__defaults__", (64,))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(model.peaks(texts), whole, strict=True))
    y, w = np.array([0, 1, 0, 1, 1, 0]), np.full(6, 1.5)
    slots, sums = model.gradient(texts, y, w)
    found = dict(zip(slots.tolist(), sums / toxicity.SCALE, strict=True))

    def loss(m):
        p = m.raw(texts)[0]
        return float(-(w * np.where(y == 1, np.log(p), np.log(1 - p))).sum())

    numbers = model.dense()
    for k in (3, 200, 390, 420, len(numbers) - 1):
        up, down = (np.array(numbers, float) for _ in "ab")
        up[k] += 1e-3
        down[k] -= 1e-3
        values = []
        for x in (up, down):
            model.set_dense(x)
            values.append(loss(model))
        model.set_dense(numbers)
        assert abs((values[0] - values[1]) / 2e-3 - found[-1 - k // 8][k % 8]) < 0.02 * max(1, abs(found[-1 - k // 8][k % 8]))


def test_rare_shingles_refute_noisy_copies_without_pairs(spark):
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]

    def copy(changes):
        own = list(base)
        for i in rng.sample(range(150), changes):
            own[i] = f"x{rng.randrange(10**6)}"
        return own

    # a group of close copies, copies a little too noisy to be linked with any, and pairs of those that are
    texts = [copy(1 if i % 2 else 9 + i % 4) for i in range(120)]
    for i in range(0, 120, 20):
        texts.append([*texts[i][:70], "other", *texts[i][71:]])
    memo = near_duplicates.word_hashes()
    sets = [near_duplicates.shingle_set(" ".join(t).encode(), 2, memo) for t in texts]
    linked = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both) and not (i % 2 and j % 2 and j < 120):
                linked.add((i, j))
    assert {(i, 120 + i // 20) for i in range(0, 120, 20)} <= linked
    bits = near_duplicates.sketch(np.stack([near_duplicates.signature(s) for s in sets])).tolist()
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "doc long, set binary")
    member = spark.createDataFrame([(i, 1 if i % 2 and i < 120 else i, *b) for i, b in enumerate(bits)], ["doc", "root", *near_duplicates.BITS])
    met = near_duplicates.sharing_rare(table, member, 0.8).collect()
    assert linked <= {(r.a, r.b) for r in met}
    assert len({(r.a, r.b) for r in met}) <= len(texts)  # thousands without the places of shingles


def test_noisy_copies_of_one_text_make_few_pairs(spark):
    rng = random.Random(51)
    texts = []
    for _ in range(300):  # each near the source, which is not there; hardly any two of them near each other
        own = [f"w{j}" for j in range(146)]
        for j in rng.sample(range(146), 3):
            own[j] = f"x{rng.randrange(10**7)}"
        texts.append(" ".join(own))
    texts += [f"{t} more" for t in texts[::30]]
    memo = near_duplicates.word_hashes()
    sets = [near_duplicates.shingle_set(t.encode(), 5, memo) for t in texts]
    plain = [set(s.tolist()) for s in sets]
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])}
    bits = near_duplicates.sketch(np.stack([near_duplicates.signature(s) for s in sets])).tolist()
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "doc long, set binary")
    member = spark.createDataFrame([(i, i, *b) for i, b in enumerate(bits)], ["doc", "root", *near_duplicates.BITS])
    met = {(r.a, r.b) for r in near_duplicates.sharing_rare(table, member, 0.8).collect()}
    assert len(linked) >= 10 and linked <= met
    assert len(met) <= len(texts) + len(linked), (len(met), len(linked))


def test_parities_never_tell_linked_sets_apart(spark):
    rng = np.random.default_rng(52)
    rows = []
    for n in [1, 4, 5, 9, 20, 40, 150, 400, 3000] * 40:
        union = rng.integers(0, 1 << 63, n).astype(np.uint64)
        differ = rng.permutation(n)[: n // 5]  # the most that a linked pair can differ in
        cut = rng.integers(0, len(differ) + 1)
        sets = [np.sort(np.delete(union, differ[:cut])), np.sort(np.delete(union, differ[cut:]))]
        odd = near_duplicates.parities(sets)
        rows.append((len(sets[0]), len(sets[1]), *map(int, odd[0]), *map(int, odd[1])))
    names = ["na", "nb", *[f"{c}a" for c in near_duplicates.ODD], *[f"{c}b" for c in near_duplicates.ODD]]
    assert spark.createDataFrame(rows, names).where(near_duplicates.few_differ(0.8)).count() == len(rows)


def shuffled_rows(df):
    """Rows written to shuffles by the plan of ``df``, which has run."""
    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            return walk(p.plan())
        kids = p.children()
        own = p.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_only_rows_that_are_wanted_move(spark, monkeypatch):
    rng = random.Random(41)
    texts = [words(rng, 40, 10_000) for _ in range(600)]
    texts += [f"{t} again" for t in texts[:6]]
    store, moved = near_duplicates.materialize, {}

    def watched(df, name, *others):
        if name in ("nd_sets", "nd_likely", "nd_possible", "nd_links"):
            df.collect()
            moved[name] = max(moved.get(name, 0), shuffled_rows(df))
        return store(df, name, *others)

    monkeypatch.setattr(near_duplicates, "materialize", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_duplicates.without_copies(docs_of(spark, texts))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(600))
        moved["kept"] = shuffled_rows(kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(n < 200 for n in moved.values()), moved


@pytest.mark.parametrize("most", [1, 1 << 19])
def test_sifting_keeps_all_that_is_wanted(spark, monkeypatch, most):
    monkeypatch.setattr(near_duplicates, "WORDS", most)
    rows = spark.range(4000).selectExpr("id * 7 - 900 AS key", "1L AS _word", "2L AS _bits").cache()
    wanted = spark.range(0, 28_000, 210).selectExpr("id - 900 AS key").cache()
    some, others = (near_duplicates._sifted(rows, "key", wanted, how) for how in ("left_semi", "left_anti"))
    assert some.columns == rows.columns and some.join(wanted, "key").count() == wanted.count()
    assert some.count() + others.count() == 4000 and some.unionByName(others).distinct().count() == 4000
    if most > 1:
        assert some.count() < 1000
    rng = random.Random(43)
    texts = [words(rng, 20, 10_000) for _ in range(20)]
    texts += [*[f"{t} again" for t in texts[:4]], texts[0], *EDGE]
    docs = docs_of(spark, texts)
    sizes, root = brute_groups(texts)
    got = {r.doc_id: r for r in near_duplicates.groups(docs.unionByName(docs)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == list(zip(sizes, root, strict=True))
