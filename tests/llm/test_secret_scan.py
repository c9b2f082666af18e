"""Secret scans on hand-made texts: base matches against plain patterns, keys and tokens built field by field."""

import base64
import json
import random
import re

import pytest

from sward.llm import secret_scan
from sward.llm.common import ship

DOCS = "doc_id long, text string, base string, spans string, key string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([128 + len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RNG = random.Random(7)
RSA = der(48, number(0), *[number(RNG.getrandbits(b)) for b in (1024, 17, 1023, 512, 512, 511, 510, 509)])
CURVE = der(48, number(1), der(4, RNG.randbytes(32)), der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
WRAPPED = der(48, number(0), der(48, der(6, b"\x2b\x65\x70")), der(4, der(4, RNG.randbytes(32))))
PUBLIC = der(48, der(48, der(6, b"\x2b\x65\x70")), der(3, b"\x00" + RNG.randbytes(32)))


def ssh_string(b):
    return len(b).to_bytes(4, "big") + b


SSH = b"openssh-key-v1\0" + b"".join(map(ssh_string, (b"none", b"none", b""))) + (1).to_bytes(4, "big") + ssh_string(RNG.randbytes(51)) + ssh_string(RNG.randbytes(136))


def b64(data, url=False, pad=True):
    out = (base64.urlsafe_b64encode if url else base64.b64encode)(data).decode()
    return out if pad else out.rstrip("=")


def token(header, body, signature):
    return ".".join(b64(x, True, False) for x in (json.dumps(header).encode(), json.dumps(body).encode(), signature))


JWT = token({"alg": "HS256", "typ": "JWT"}, {"sub": "1"}, RNG.randbytes(32))


def lines(s, n=64):
    return "\n".join(s[i : i + n] for i in range(0, len(s), n))


PLAIN = {
    "assign": (r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def plain(text):
    found = [(m.start(), k, m.end()) for k, (name, (p, ok)) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if ok(m)]
    return [(list(PLAIN)[k], a, b) for a, k, b in sorted(found)]


def test_base_matches_agree_with_plain_patterns():
    rng = random.Random(3)
    bits = ["token", "PassWd", "api_key", "apikey", "toKen", "ſecret", "=", ":", " ", '"', "'", "AKIA", "0123456789abcdef", "ABCDEF0123456789", "deadbeef", "x-_.+/", "é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert secret_scan.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    ("secret", "kind"),
    [(b64(RSA), "key"), (b64(RSA, True, False), "key"), (lines(b64(RSA)), "key"), (lines(b64(RSA)).replace("\n", "\\n"), "key"), (b64(CURVE), "key"), (b64(WRAPPED), "key"), (RSA.hex(), "key"), (WRAPPED.hex().upper(), "key"),
     (b64(SSH), "ssh_key"), (lines(b64(SSH), 70), "ssh_key"), (JWT, "token"), (b64(JWT.encode()), "token"), (b64(b64(JWT.encode()).encode()), "token")],
)
def test_keys_and_tokens_are_confirmed(secret, kind):
    for before, after in (("", ""), ("use ", " now"), ("é -----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----\n")):
        text = before + secret + after
        assert [s for s in secret_scan.structured(text) if s[0] == kind] == [(kind, len(before), len(before) + len(secret))]


def test_what_only_looks_like_a_secret_is_left_alone():
    for text in (b64(PUBLIC), b64(RSA[:-5]), b64(RNG.randbytes(400)), b64(b"plain words that say nothing at all"), "Donaudampfschifffahrtsgesellschaftskapitaen" * 3, token({"alg": "HS256"}, {"a": 1}, b"short"),
                 token({"typ": "JWT"}, {"a": 1}, RNG.randbytes(32)), token({"alg": "HS256"}, [1], RNG.randbytes(32)), "a" * 100_000, "MII" * 50_000, "eyJ." * 10_000, "30" * 20_000):
        assert list(secret_scan.structured(text)) == []
    assert not secret_scan.is_private_key(bytes(der(48, number(0), number(1))))


def test_rows(spark):
    texts = [None, "", "   ", f"token = {JWT} and {RSA.hex()}", f"token = {JWT} and {RSA.hex()}", "word " * 50_000 + "AKIA" + "Z" * 16]
    rows = [(None if i == 4 else i, t, "b", "s", "k") for i, t in enumerate(texts)]
    found = secret_scan.find(spark.createDataFrame(rows, DOCS))
    got = secret_scan.digest(found).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].spans == by_id[1].spans == by_id[2].spans == "" and by_id[None].spans == by_id[3].spans
    assert {s.split(":")[0] for s in by_id[3].spans.split(",")} == {"assign", "token", "hex", "key"}
    assert (by_id[5].n_access, by_id[5].spans) == (1, "access:250000:250020")
    assert secret_scan.find(spark.createDataFrame([], DOCS)).count() == 0
    assert secret_scan.masked("a token b", [(2, 7), (4, 8)]) == "a <SECRET>b"
