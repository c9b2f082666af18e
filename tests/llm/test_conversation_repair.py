"""Conversation repair against a search over all edits, in one stretch and in many."""

import hashlib
import random
import re

import pytest
from oracle import compare

from sward.llm import conversation_repair as cr
from sward.llm.common import ship

TURNS = "conv_id long, turn long, role string, text string, mark string, n long, head string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def plain(rows):
    """Counts, cheapest audit and repaired lines, by a table over places and role strings' states, spelled out."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(0, ""): (0, "", ())}  # (rows read, initials) -> cost, audit, lines
    for i in range(len(rows) + 1):
        for _ in range(3):  # turns put in before row i
            for (at, roles), (c, a, lines) in list(best.items()):
                if at == i:
                    for new in ("user", "assistant"):
                        _better(best, (i, _state(roles + new[0])), (c + 5, a + "I", (*lines, f"{new}:")))
        if i == len(rows):
            break
        _, role, text = rows[i]
        for (at, roles), (c, a, lines) in list(best.items()):
            if at == i:
                _better(best, (i + 1, roles), (c + 2, a + "D", lines))
                if faults[i] not in ("blank", "duplicate"):
                    late = 5 * (faults[i] == "truncated")
                    if role[:1] in ("s", "u", "a"):
                        _better(best, (i + 1, _state(roles + role[0])), (c + late, a + "K", (*lines, f"{role}:{text}")))
                    for new in ("user", "assistant"):
                        _better(best, (i + 1, _state(roles + new[0])), (c + 1 + late, a + "R", (*lines, f"{new}:{text}")))
    cost, audit, lines = min(v for (at, roles), v in best.items() if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def _state(roles):
    """Initials that behave alike; what can become no legal string keeps an x."""
    if "x" in roles or not re.fullmatch("s?(ua)*u?", roles):
        return "x"
    return re.sub("(ua)+", "ua", roles)


def _better(best, key, value):
    if key[1] != "x" and (key not in best or value < best[key]):
        best[key] = value


def random_turns(rng, n):
    roles = ["user", "assistant", "system", "unit", "tool", " ", ""]
    texts = ["Yes.", "no", "Why? \n", "", " \t", "ok!", "é.", "cut,"]
    return [(rng.choice([None, *range(2 * n)]) if rng.random() < 0.3 else i, rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts) + (str(i) + "." if rng.random() < 0.5 else "")) for i in range(n)]


@pytest.mark.parametrize("stretch", [256, 3])
def test_audits_agree_with_a_search_over_all_edits(spark, stretch):
    rng = random.Random(stretch)
    convs = {i: random_turns(rng, rng.randrange(1, 9)) for i in range(60)} | {None: random_turns(rng, 6), 70: random_turns(rng, 40), 71: [(0, "user", "Hi.")] * 9}
    rows = [(c, t, r, x, "m", 1, "h") for c, own in convs.items() for t, r, x in own]
    rng.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in cr.repair(spark.createDataFrame(rows, TURNS), stretch=stretch).collect()}
    lines: dict = {}
    for r in cr.repaired(spark.createDataFrame(rows, TURNS), stretch=stretch).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, own in convs.items():
        want, text = plain(own)
        assert got[c] == want, (c, own)
        assert tuple(lines.get(c, ())) == text


def test_shared_endings_are_solved_once():
    ends = cr.Endings([cr.ACCEPTING])
    words = sorted(w[::-1] for w in ("ua", "ua" * 5, "s" + "ua" * 5, "d" + "ua" * 5, "uaU"))
    for w in words:
        ends.solve(w)
    assert ends.built == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    cost, edits = ends.solve("suu"[::-1])[0][cr.START]
    assert (cost, cr.spelled(edits)) == (1, "KKR")


def test_damage_and_empty_tables(spark, sf_dir):
    rows = spark.createDataFrame([(1, 0, None, None, "m", 1, "h"), (None, None, "user", "Hi.", "m", 1, "h"), (None, None, "user", "Hi.", "m", 1, "h")], TURNS)
    got = {r.conv_id: r for r in cr.repair(rows).collect()}
    assert (got[1].blank, got[1].audit) == (1, "D") and (got[None].duplicate, got[None].audit, got[None].gaps) == (1, "DD", 0)
    none = rows.where("conv_id = 7")
    assert cr.repair(cr.damage(none), "copies").count() == 0 and cr.repaired(none).count() == 0
    gone = cr.repair(rows.withColumn("copies", cr.F.lit(0)), "copies").collect()
    assert {(r.cost, r.audit, r.repaired_sha256) for r in gone} == {(0, "", hashlib.sha256(b"").hexdigest())} and len(gone) == 2


def test_query_agrees_with_sql(spark, sf_dir):
    from oracle import connect

    from sward.llm.queries import ORACLES, QUERIES

    ok, note = compare(QUERIES["op12_conversation_repair"](spark, sf_dir), connect(sf_dir), ORACLES["op12_conversation_repair"])
    assert ok, note
