"""The prefix trie against a plain dictionary of prefixes, its queue against sorting."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from oracle import compare, connect

from sward.llm import prefix_trie as pt
from sward.llm.common import ship

TURNS = "conv_id long, turn long, role string, text string, node string, part long, _base string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def plain(rows, grafted):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    seqs = {c: [(r, x) for _, _, r, _, x in sorted(own)] for c, own in convs.items()}
    if grafted:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in seqs}
        base = {c: c - (c % 5 if c >= 0 else -(-c % 5)) for c in seqs}
        seqs = {c: seqs.get(base[c], [])[: h[c]] + own[h[c] :] for c, own in seqs.items()}
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, own in members.items():
        done = sorted(c for c in own if len(seqs[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, done)).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 12)):
            rows.append((c * rng.choice([1, 1, -1]), rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", None, "b b"])))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1030) for t in range(6)] + [(2000, t, "u", "x") for t in range(300)] + [(2001, 0, "u", "x")] * 40 + [(2005, t, "u", "x") for t in range(300)] + [(None, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("grafted", "held"), [(False, 2), (True, 100)])
def test_nodes_agree_with_a_dictionary_of_prefixes(spark, grafted, held):
    rows = random_rows(random.Random(held), 120)
    df = spark.createDataFrame([(*r, "n", 1, "b") for r in rows], TURNS).repartition(7)
    got = pt.rebuilt(df) if grafted else pt.trie(df, held=held)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, grafted)


def test_few_rows(spark):
    one = spark.createDataFrame([(7, None, None, None, "n", 1, "b")], TURNS)
    assert sorted((tuple(r) for r in pt.trie(one).collect()), key=str) == plain([(7, None, None, None)], False)
    two = spark.createDataFrame([(c, 0, "u", "é" * 100_000, "n", 1, "b") for c in (4, 9)], TURNS)
    assert sorted((tuple(r) for r in pt.trie(two).collect()), key=str) == plain([(c, 0, "u", "é" * 100_000) for c in (4, 9)], False)
    assert pt.trie(one.where("conv_id = 1")).count() == 0


def test_queue_spills_and_keeps_order():
    rng, queue, sent = random.Random(1), pt.SpillingQueue(5), defaultdict(list)
    for level in range(-9, 0):
        for node in sorted({k[1] for k in sent} | {pt.named(99)}):
            own = sent.pop((level, node), [])
            assert queue.take(level, node) == (len(own), *([sum(c) for c in zip(*own, strict=True)] or (0, 0, 0)))
        for _ in range(40):
            m = (level + 1, pt.named(rng.randrange(20)), rng.randrange(9), 1, rng.randrange(9))
            queue.push(m)
            sent[m[:2]].append(m[2:])
    assert queue.spills > 9


def test_query_agrees_with_sql(spark, sf_dir):
    from sward.llm.queries import ORACLES, QUERIES

    ok, note = compare(QUERIES["op13_prefix_trie"](spark, sf_dir), connect(sf_dir), ORACLES["op13_prefix_trie"])
    assert ok, note
