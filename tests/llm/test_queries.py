"""Every operator's query on the small tables, its contract columns against a plain version."""

import hashlib
import re

import pytest

from sward.llm.pii import KINDS
from sward.llm.queries import QUERIES


def sha(parts, sep=","):
    return hashlib.sha256(sep.join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"[^0-9]", "", m)) <= 19 and luhn(re.sub(r"[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
}


def test_personal_data_query(spark, sf_dir, texts):
    rows = QUERIES["op5_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    some = dict.fromkeys(KINDS, 0)
    for r in rows:
        spans = {k: [m.span() for m in re.finditer(p, texts[r.doc_id]) if good(m[0])] for k, (p, good) in PLAIN.items()}
        base = [f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k]]
        assert [r[f"n_{k}"] for k in KINDS] == [len(spans[k]) for k in KINDS]
        assert r.base_sha256 == sha(base) and set(base) <= set(r.spans.split(","))
        some = {k: some[k] + len(spans[k]) for k in KINDS}
    assert all(some.values()) and len(set(some.values())) > 1


def test_secrets_query(spark, sf_dir, texts):
    from test_secret_scan import plain

    rows = QUERIES["op11_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == sha([f"{k}:{a}:{b}" for k, a, b in base])
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
    assert sum(r.n_hex for r in rows) and sum(r.n_assign for r in rows)


CLASHING = ("_key", "_text_key", "_spans", "_hidden", "_row", "_now", "_changed", "_clean_text", "_t1", "_T2", "text_key", "n", "h1", "first", "doc")


@pytest.mark.parametrize("block_words", [50_000, 2])
def test_stages_keep_columns_of_any_name(spark, block_words):
    from sward.llm import decontaminate, near_duplicates, pii
    from sward.llm.common import ship

    ship(spark)
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "other words that make a second block of items here today yes")], "item_id long, text string")
    texts = [f"clean {item} text that goes on and on for many more words so that it stays", "mail me at a.b@example.org now", "mail me at a.b@example.org now", None, ""]
    rows = [(i, t, len(t or ""), *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHING))

    def kept(df):
        got = sorted(df.collect(), key=lambda r: r.doc_id)
        assert df.columns == docs.columns and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHING)
        assert all((r.n_chars or 0) == len(r.text or "") for r in got)
        return {r.doc_id: r.text for r in got}

    clean = kept(decontaminate.decontaminate(docs, bench, block_words=block_words))
    assert "seven" not in clean[0] and {i: clean[i] for i in (1, 2, 3, 4)} == {i: texts[i] for i in (1, 2, 3, 4)}
    assert kept(pii.redact(docs)) == {0: texts[0], 1: "mail me at <EMAIL> now", 2: "mail me at <EMAIL> now", 3: None, 4: ""}
    if block_words > 2:
        assert sorted(kept(near_duplicates.without_copies(docs))) == [0, 1, 3, 4]


def crc(key):
    import zlib

    return zlib.crc32(str(key).encode())


def test_language_query(spark, sf_dir, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op2_language"](spark, sf_dir).collect()
    learned = {lang for d, lang in langs.items() if lang and crc(d) % 3 != 1}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        blank = not any(c.isalpha() for c in texts[r.doc_id])
        assert r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") if blank else (r.lang_pred in learned)
    tried = [r for r in rows if r.held_out and r.lang_pred != "und" and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in tried) >= 0.97 * len(tried) > 0


@pytest.mark.parametrize(("name", "label", "least", "right"), [("op3_toxicity", "toxic", 0.5, 0.9), ("op4_quality", "quality", 0.3, 0.9)])
def test_classifier_queries(spark, sf_dir, texts, name, label, least, right):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in rows)
    tried = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in tried) >= right * len(tried) > 0


def test_near_duplicates_query(spark, sf_dir, texts):
    def shingles(text):
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        return frozenset(tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))) if words else frozenset()

    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    ids = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 80 * len(sets[b]) > 100 * len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    rows = QUERIES["op7_near_duplicates"](spark, sf_dir).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {(d, len(s), top(d), top(d) == d) for d, s in sets.items()} and len(rows) == len(texts)


def test_language_model_query(spark, sf_dir, texts):
    import math
    from collections import Counter

    def tokens(text):
        return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.split(r"[\x20\x09-\x0D]+", text) if w] + [None]

    learned = Counter(w for d, t in texts.items() if crc(d) % 7 != 2 for w in tokens(t))
    n, v = sum(learned.values()), len(learned)
    rows = QUERIES["op8_language_model"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(own), sum(w in learned for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_packing_and_pipeline_queries(spark, sf_dir, texts):
    packed = QUERIES["op9_packing"](spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} >= {d for d, t in texts.items() if t.strip()}
    rows = QUERIES["pipeline"](spark, sf_dir)
    kept = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < len(texts) and kept <= set(texts)
