from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.op8_pii import op8_pii
from tessera.llm.common import table
from tessera.llm.pii import KINDS, find_pii, luhn, patterns, scan, transduced


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15])


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(60_000):
        text = "".join(rng.choice(rng.choice(["a.@b", "1.23", "+1 (2)-", "@..a1", " 4-", "0٣é"])) for _ in range(rng.randint(0, 40)))
        assert patterns(text) == base(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe (at) example (dot) com now", "email_hidden", "john.doe (at) example (dot) com"), ("to joe[at]mail[dot]example[dot]org.", "email_hidden", "joe[at]mail[dot]example[dot]org"), ("john at example dot com", "email_hidden", "john at example dot com"), ("see joe@exаmple.com", "email_hidden", "joe@exаmple.com"),
        ("x １９２.168.0.1 x", "ip_hidden", "１９２.168.0.1"), ("phone +１ (743) 555-3824", "phone_hidden", "+１ (743) 555-3824"), ("card four one one one one one one one one one one one one one one one ok", "card_hidden", "four" + " one" * 15),
        ("call +1 seven four three 555 3824 now", "phone_hidden", "+1 seven four three 555 3824"), ("call +1 743 555 three eight two four.", "phone_hidden", "+1 743 555 three eight two four"), ("plus one 743 555 3824", "phone_hidden", "plus one 743 555 3824"), ("+\uff11 " + " " * 90 + "743 555 3824", "phone_hidden", "+\uff11 " + " " * 90 + "743 555 3824"),
        ("write john At example Dot com", "email_hidden", "john At example Dot com"), ("write john at example.com", "email_hidden", "john at example.com"), ("joe (arroba) correo (punto) es", "email_hidden", "joe (arroba) correo (punto) es"), ("joe@example dot com", "email_hidden", "joe@example dot com"), ("10 dot 0 dot 0 dot one", "ip_hidden", "10 dot 0 dot 0 dot one"), ("+49 drei null fünf 555 3824", "phone_hidden", "+49 drei null fünf 555 3824"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    assert [(KINDS[k], text[a:b]) for a, k, b in scan(text)] == [(kind, span)]


@pytest.mark.parametrize("text", ["nothing here", "meet at noon", "one two three", "été déjà vu", "a (dot) on a map", "the one two four five men", "３ pommes"])
def test_clean_text_stays_clean(text):
    assert scan(text) == []


def whole(text):
    """Hidden spans by rewriting the whole text at once."""
    plain, start, end = transduced(text)
    found = patterns(text)
    return sorted({(start[a], k + 4, end[b - 1]) for a, k, b in patterns(plain) if plain != text and not any(x <= start[a] and end[b - 1] <= y for x, _, y in found)})


def test_stretches_give_what_the_whole_text_gives():
    rng = random.Random(4)
    bits = ["joe", "example", " at ", " dot ", "(at)", "[dot]", ".com", "@", "com", "one", "two ", " three", "-", " ", " ", ", ", "\n", ":", "+1 ", "plus ", "743", "555-3824", "１", "\u200b", "а", "10.", "4111 1111 1111 1111", "(", ")", "été", "/", "null ", "oh ", "ſix ", "SEVEN-", "Punto", " DOT ", "³", "ﬁve"]
    for _ in range(30_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 18)))
        assert [s for s in scan(text) if s[1] > 3] == whole(text), text


def test_edges(documents):
    df = documents([(1, "é a.b@c.de 10.0.0.1 +1 (555) 123-4567, 4111 1111 1111 1112")])
    got = {r.doc_id: r for r in df.select("doc_id", find_pii(F.col("text")).alias("s")).select("doc_id", "s.*").collect()}
    assert got[900].base_sha256 == hashlib.sha256(b"").hexdigest() and got[902].spans == ""
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1)
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base(df.where("doc_id = 1").first().text)).encode()).hexdigest()
    assert documents(edges=False).select(find_pii(F.col("text"))).count() == 0


def test_query(spark, sample):
    got = {r.doc_id: r for r in op8_pii(spark, sample).collect()}
    rows = table(spark, sample, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base(r.text or "")]
        own = got[r.doc_id]
        assert own.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(own.spans.split(",") if own.spans else [])
        assert [own.n_email, own.n_ip, own.n_card, own.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in ("email", "ip", "card", "phone")]
